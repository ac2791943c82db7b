"""Toxicity by a convolutional classifier over hashed word embeddings.

A word's embedding is the sum of the hashed embeddings of the word and of its
first letters, so forms of one stem share what is learned. Filters of several
widths slide over the words; each filter's largest response anywhere in the text
goes into a linear layer. The network is trained in numpy on a bounded sample of
labelled rows; the sample's other rows set a threshold per language, and the
threshold is moved to a score of one half. The language is guessed from the
words, never read from a column.

Defined cases: a missing text, or one without a word, gets the score of no
response; labels that are missing teach nothing, and of several labels of a row
the largest counts; without positive or without negative labels the score is the
share of positives (zero without labels); repeated rows are scored each; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import in_fold, map_batches, quoted

HELD_OUT = 0
#: Labelled rows that train and calibrate the network, about (a hash of the id draws them).
TRAIN_TOXIC, TRAIN_CLEAN = 2_000, 4_000
#: Share of the sample that only sets thresholds.
CALIBRATION = 0.25
BUCKETS = 1 << 15
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
STEMS = (3, 4, 5, 6)
EPOCHS = 6
BATCH_DOCS = 32
RATE = 0.05
#: Positive rows a language needs for a threshold of its own.
OWN_THRESHOLD = 15
KEPT_WORDS = 100_000
#: Words whose responses are held at once.
BLOCK_WORDS = 65_536
#: Bytes of texts whose words are held at once.
SLICE_BYTES = 1 << 20
SEED = 42
_WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def word_buckets(word: str) -> list[int]:
    """Buckets of the word and of its stems; BUCKETS stands for no stem."""
    data = word.encode()
    own = [zlib.crc32(data) % BUCKETS]
    own += [zlib.crc32(word[:n].encode() + b"-") % BUCKETS if len(word) > n else BUCKETS for n in STEMS]
    return own


@dataclass
class Network:
    """Embeddings, filters and the linear layer, and what turns a response into a score."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # by width: (width, DIMENSIONS, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    languages: list[str] = field(default_factory=list)
    profiles: np.ndarray | None = None  # (BUCKETS + 1, languages): log chances of a word's bucket
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    constant: float | None = None

    def responses(self, buckets: np.ndarray) -> np.ndarray:
        """Per word: its part in every filter by its place in the window, then its language chances."""
        x = self.embedding[buckets].sum(axis=1)
        parts = [x @ self.filters[w][j] for w in WIDTHS for j in range(w)]
        return np.hstack([*parts, self.profiles[buckets[:, 0]]]).astype(np.float32)


def _pooled(rows: np.ndarray, starts: int) -> np.ndarray:
    """The largest response of every filter over windows that start at the first ``starts`` words; a text ends in blanks."""
    out, at = [], 0
    for width in WIDTHS:
        total = np.zeros((len(rows), FILTERS), dtype=np.float32)
        for j in range(width):
            part = rows[j:, at : at + FILTERS]
            total[: len(part)] += part
            at += FILTERS
        out.append(total[:starts].max(axis=0))
    return np.concatenate(out)


_PARTS = FILTERS * sum(WIDTHS)


def pooled_text(rows_of, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(filter maxima, language sums) of a text, block by block: windows start in a block and may end behind it."""
    best = np.full(FILTERS * len(WIDTHS), -np.inf, dtype=np.float32)
    languages = 0.0
    for at in range(0, n_words, BLOCK_WORDS):
        rows = rows_of(at, min(n_words, at + BLOCK_WORDS + max(WIDTHS) - 1))
        best = np.maximum(best, _pooled(rows, BLOCK_WORDS))
        languages = languages + rows[:BLOCK_WORDS, _PARTS:].sum(axis=0, dtype=np.float64)
    return best, languages


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _train(docs: list[np.ndarray], y: np.ndarray, network: Network) -> None:
    """Adagrad over small batches; only the pooled places get gradients."""
    draw = np.random.default_rng(SEED)
    offsets = [FILTERS * i for i in range(len(WIDTHS))]
    square_e = np.full(BUCKETS + 1, 0.1)
    square = {w: np.full_like(f, 0.1) for w, f in network.filters.items()}
    square_b, square_v, square_o = np.full_like(network.bias, 0.1), np.full_like(network.weights, 0.1), 0.1
    importance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(EPOCHS):
        order = draw.permutation(len(docs))
        for at in range(0, len(order), BATCH_DOCS):
            own = order[at : at + BATCH_DOCS]
            grad_f = {w: np.zeros_like(f) for w, f in network.filters.items()}
            grad_b, grad_v, grad_o = np.zeros_like(network.bias), np.zeros_like(network.weights), 0.0
            rows, values = [], []
            for d in own:
                buckets = docs[d]
                x = network.embedding[buckets].sum(axis=1)
                x = np.vstack([x, np.zeros((max(WIDTHS) - 1, DIMENSIONS))])
                n = len(buckets)
                pooled, places = np.zeros(FILTERS * len(WIDTHS)), []
                for k, w in enumerate(WIDTHS):
                    total = sum(x[j : j + n] @ network.filters[w][j] for j in range(w))
                    place = total.argmax(axis=0)
                    places.append(place)
                    pooled[offsets[k] : offsets[k] + FILTERS] = total[place, np.arange(FILTERS)]
                hidden = np.maximum(pooled + network.bias, 0)
                error = (_sigmoid(hidden @ network.weights + network.offset) - y[d]) * importance[d] / len(own)
                grad_v += error * hidden
                grad_o += error
                back = error * network.weights * (hidden > 0)
                grad_b += back
                for k, w in enumerate(WIDTHS):
                    g = back[offsets[k] : offsets[k] + FILTERS]
                    for f in np.flatnonzero(g):
                        for j in range(w):
                            place = places[k][f] + j
                            grad_f[w][j][:, f] += g[f] * x[place]
                            if place < n:
                                rows.append(buckets[place])
                                values.append(g[f] * network.filters[w][j][:, f])
            if rows:
                index = np.concatenate(rows)
                each = np.repeat(np.array(values), len(STEMS) + 1, axis=0)
                touched, inverse = np.unique(index, return_inverse=True)
                grad = np.zeros((len(touched), DIMENSIONS))
                np.add.at(grad, inverse, each)
                square_e[touched] += (grad**2).mean(axis=1)
                network.embedding[touched] -= RATE * grad / np.sqrt(square_e[touched])[:, None]
                network.embedding[BUCKETS] = 0.0
            for w in WIDTHS:
                square[w] += grad_f[w] ** 2
                network.filters[w] -= RATE * grad_f[w] / np.sqrt(square[w])
            square_b += grad_b**2
            network.bias -= RATE * grad_b / np.sqrt(square_b)
            square_v += grad_v**2
            network.weights -= RATE * grad_v / np.sqrt(square_v)
            square_o += grad_o**2
            network.offset -= RATE * grad_o / np.sqrt(square_o)


def _fresh(docs: list[np.ndarray], y: np.ndarray) -> Network:
    """Random filters; the first dimension starts from each bucket's log odds among the labels."""
    draw = np.random.default_rng(SEED)
    seen = np.zeros((BUCKETS + 1, 2))
    for buckets, label in zip(docs, y):
        seen[np.unique(buckets), int(label)] += 1
    sizes = np.array([(y == 0).sum(), (y == 1).sum()])
    chance = (seen + 0.5) / (sizes + 1.0)
    odds = np.log(chance[:, 1] / chance[:, 0])
    known = seen.sum(axis=1)
    embedding = draw.normal(0, 0.05, (BUCKETS + 1, DIMENSIONS))
    embedding[:, 0] = odds * known / (known + 5.0) / (len(STEMS) + 1)
    embedding[BUCKETS] = 0.0
    filters = {w: draw.normal(0, 0.1, (w, DIMENSIONS, FILTERS)) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][:, 0, :] = np.abs(filters[w][:, 0, :]) + 0.5 / w
    hidden = FILTERS * len(WIDTHS)
    return Network(embedding, filters, np.full(hidden, -0.5), np.full(hidden, 1.0 / hidden), -1.0)


def _profile(network: Network, docs: list[np.ndarray], languages: list[str | None]) -> None:
    """Chances of word buckets per language, for guessing a text's language."""
    names = sorted({x for x in languages if x is not None}) or [""]
    counts = np.full((BUCKETS + 1, len(names)), 0.05)
    for buckets, name in zip(docs, languages):
        if name is not None:
            np.add.at(counts[:, names.index(name)], buckets[:, 0], 1.0)
    network.languages = names
    network.profiles = np.log(counts / counts.sum(axis=0))


def _logit(network: Network, rows: np.ndarray) -> tuple[float, str]:
    best, languages = pooled_text(lambda a, b: rows[a:b], len(rows))
    hidden = np.maximum(best + network.bias, 0)
    return float(hidden @ network.weights + network.offset), network.languages[int(np.argmax(languages))]


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between logits at which the F1 measure is best."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order] == 1)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + (y == 1).sum())
    ends = np.flatnonzero(np.append(np.diff(logits[order]) != 0, True))  # ties stay together
    last = ends[int(f1[ends].argmax())]
    below = logits[order][last + 1] if last + 1 < len(y) else logits[order][last] - 2.0
    return float((logits[order][last] + below) / 2)


def fit(texts: Sequence[str | None], labels: Sequence[int], languages: Sequence[str | None]) -> Network:
    """Train on part of the labelled texts, set thresholds on the rest."""
    y = np.asarray(labels)
    held = np.random.default_rng(SEED).random(len(y)) < CALIBRATION
    kept: dict[str, list[int]] = {}

    def buckets(text: str | None) -> np.ndarray:
        rows = []
        for word in words_of(text):
            if word not in kept:
                kept[word] = word_buckets(word)
            rows.append(kept[word])
        return np.array(rows, dtype=np.int32).reshape(-1, len(STEMS) + 1)

    docs = [buckets(t) for t in texts]
    taught = [i for i in range(len(y)) if not held[i] and len(docs[i])]
    if len({int(y[i]) for i in taught}) < 2:
        return Network(
            np.zeros((BUCKETS + 1, DIMENSIONS)), {}, np.zeros(0), np.zeros(0), 0.0,
            constant=float(y.mean()) if len(y) else 0.0,
        )
    network = _fresh([docs[i] for i in taught], y[taught])
    _profile(network, [docs[i] for i in taught], [languages[i] for i in taught])
    _train([docs[i] for i in taught], y[taught], network)
    judged = [i for i in range(len(y)) if len(docs[i]) and held[i]] or taught
    found = [_logit(network, network.responses(docs[i])) for i in judged]
    logits, own = np.array([f[0] for f in found]), np.array([f[1] for f in found])
    network.threshold = best_threshold(logits, y[judged]) if y[judged].any() else float(logits.max() + 1)
    for name in network.languages:
        at = own == name
        if (y[judged][at] == 1).sum() >= OWN_THRESHOLD:
            network.thresholds[name] = best_threshold(logits[at], y[judged][at])
    return network


def score_texts(docs: DataFrame, keep: Sequence[str], text: str, network: Network) -> DataFrame:
    """The kept columns, score, predicted and the guessed language."""

    def make():
        numbers: dict[str, int] = {}
        table = [np.zeros((0, _PARTS + len(network.languages)), dtype=np.float32)]

        def step(texts):
            found = [words_of(t) for t in texts.to_pylist()]
            scores, names = [], []
            if network.constant is None:
                if len(numbers) > KEPT_WORDS:
                    numbers.clear()
                    table[0] = table[0][:0]
                new = list(dict.fromkeys(w for words in found for w in words if w not in numbers))
                if new:
                    numbers.update(zip(new, range(len(numbers), len(numbers) + len(new))))
                    own = np.array([word_buckets(w) for w in new], dtype=np.int32)
                    blocks = [network.responses(own[i : i + BLOCK_WORDS]) for i in range(0, len(own), BLOCK_WORDS)]
                    table[0] = np.vstack([table[0], *blocks])
            for words in found:
                if network.constant is not None:
                    scores.append(network.constant)
                    names.append(None)
                    continue
                if not words:
                    scores.append(float(_sigmoid(network.offset - network.threshold)))
                    names.append(None)
                    continue
                index = np.array([numbers[w] for w in words])
                best, languages = pooled_text(lambda a, b: table[0][index[a:b]], len(index))
                name = network.languages[int(np.argmax(languages))]
                logit = float(np.maximum(best + network.bias, 0) @ network.weights + network.offset)
                scores.append(float(_sigmoid(logit - network.thresholds.get(name, network.threshold))))
                names.append(name)
            predicted = [int(s >= 0.5) for s in scores]
            return None, [pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(names, pa.string())]

        return step

    return map_batches(docs, keep, [quoted(text)], "score double, predicted int, guessed_lang string", make, SLICE_BYTES)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str,
    label: str,
    held_out: int,
    most: Sequence[int],
    columns: Sequence[Column],
) -> DataFrame:
    """About ``most[y]`` training rows of each label y (0 or 1): the columns, then ``y``.

    Only the labels' ids are counted and drawn; the drawn ids, bounded by
    ``most``, are joined to the documents by broadcast.
    """
    y = quoted(label)
    known = labels.where(y.isNotNull() & quoted(doc_id).isNotNull() & ~in_fold(doc_id, held_out))
    known = known.groupBy(quoted(doc_id).alias("id")).agg((F.max(y) > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    draw = F.pmod(F.xxhash64("id", F.lit("labelled")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, most[1] / max(1, sizes.get(1, 0))).otherwise(most[0] / max(1, sizes.get(0, 0)))
    drawn = known.where(draw < share)
    first = docs.select(quoted(doc_id).alias("id"), *[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return first.join(F.broadcast(drawn), "id")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    label: str = "toxic",
    held_out: int = HELD_OUT,
    most: Sequence[int] = (TRAIN_CLEAN, TRAIN_TOXIC),
) -> Network:
    sample = labelled_sample(docs, labels, doc_id, label, held_out, most, [quoted(text), quoted(lang)])
    rows = sample.orderBy("id", "c0").select("c0", "y", "c1").toArrow()  # bounded by ``most``
    return fit(*[rows.column(i).to_pylist() for i in range(3)])


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, guessed_lang."""
    network = learn(docs, labels, doc_id, text)
    named = docs.select(
        quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), in_fold(doc_id, HELD_OUT).alias("held_out")
    )
    return score_texts(named, ["doc_id", "held_out"], "text", network)


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, columns unchanged."""
    columns = docs.columns
    scored = score_texts(docs, columns, text, learn(docs, labels, doc_id, text))
    kept = [f"c{i}" for i in range(len(columns))]
    return scored.toDF(*kept, "score", "predicted", "guessed").where("predicted = 0").select(*kept).toDF(*columns)
