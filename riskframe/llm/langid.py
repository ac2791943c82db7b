"""Language of whole texts by segmentation-marginalised unigrams.

Each language has a probability per piece of a fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, computed by a
forward pass; a text's is the product over its words. The piece probabilities
are learned by expectation maximisation: forward-backward passes over the words
of a training sample give expected piece counts, which Spark adds up.

Words are runs of letters in lower case, with the vocabulary's word mark in
front; a letter that no piece holds has one small probability in all languages.

Defined cases: a missing text, or one without a letter, is ``und`` with score 0;
so is every text if nothing was learned; ties go to the language first in
order; rows without language teach nothing; repeated rows count each; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import in_fold, map_batches, quoted
from riskframe.session import materialize

HELD_OUT = 0
#: Training rows per language, about (a hash of the id draws them).
TRAIN_PER_LANGUAGE = 1_500
ROUNDS = 3
#: Training reads words up to this length; longer runs of letters are junk.
TRAIN_LETTERS = 40
SMOOTHING = 0.1
UNKNOWN = 1e-7
MARK = "▁"
UNDETERMINED = "und"
#: Cells (words x languages) of word scores kept in one task.
KEPT_CELLS = 1_600_000
GROUP_WORDS = 2_048
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters; signs that only look like words (as superscripts do) are none."""
    return [w for w in _WORDS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The vocabulary's pieces of letters, numbered."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        texts = [t for t in texts if t.removeprefix(MARK).isalpha() or t == MARK]
        self.number = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        self.longest = max(map(len, self.number))

    def lattice(self, words: Sequence[str]) -> np.ndarray:
        """For words of one length n: piece number by (word, end, piece length), n ends.

        The last number stands for a letter without piece, the one after it for none.
        """
        get, none, unknown = self.number.get, len(self.number) + 1, len(self.number)
        n = len(words[0]) + 1
        out = np.full((len(words), n, min(n, self.longest)), none, dtype=np.int32)
        for w, word in enumerate(words):
            marked = MARK + word
            for first in range(n):
                for last in range(first, min(n, first + self.longest)):
                    piece = get(marked[first : last + 1])
                    if piece is not None:
                        out[w, last, last - first] = piece
                if out[w, first, 0] == none:
                    out[w, first, 0] = unknown
        return out


def by_length(words: Sequence[str], most: int = GROUP_WORDS):
    """Places of words of one length, in groups of bounded size."""
    places: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        places.setdefault(len(word), []).append(i)
    for length, own in sorted(places.items()):
        step = max(1, min(most, 65_536 // (length + 1)))
        for at in range(0, len(own), step):
            yield own[at : at + step]


def forward(lattice: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, over all segmentations.

    ``table`` has a row per piece number and a column per language. Sums are
    rescaled at every letter, so words of any length keep their precision.
    """
    count, n, longest = lattice.shape
    ends = [np.ones((count, table.shape[1]))]  # sums up to the last letters, oldest first
    scale = np.zeros((count, 1))
    for last in range(n):
        total = np.zeros_like(ends[0])
        for size in range(min(last + 1, longest)):
            total += ends[-1 - size] * table[lattice[:, last, size]]
        top = total.max(axis=1, keepdims=True)
        scale += np.log(top)
        ends = [e / top for e in [*ends, total]][-longest:]
    return np.log(np.maximum(ends[-1], 1e-300)) + scale


def expected_pieces(lattice: np.ndarray, chances: np.ndarray, weights: np.ndarray, pieces: int) -> np.ndarray:
    """Expected piece counts of weighted words of one language, by forward and backward sums."""
    count, n, longest = lattice.shape
    p = chances[lattice]
    before = np.zeros((count, n + 1))
    after = np.zeros((count, n + 1))
    before[:, 0] = after[:, n] = 1.0
    for last in range(n):
        for size in range(min(last + 1, longest)):
            before[:, last + 1] += before[:, last - size] * p[:, last, size]
    for first in range(n - 1, -1, -1):
        for size in range(min(n - first, longest)):
            after[:, first] += after[:, first + size + 1] * p[:, first + size, size]
    whole = before[:, n]
    out = np.zeros(pieces + 2)
    for size in range(longest):
        for last in range(size, n):
            share = before[:, last - size] * p[:, last, size] * after[:, last + 1]
            np.add.at(out, lattice[:, last, size], share / whole * weights)
    return out


def _sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` training rows of each language."""
    known = docs.where(F.col("lang").isNotNull() & ~F.col("held_out"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return known.join(F.broadcast(sizes), "lang").where(draw < per_language / F.col("n"))  # one row per language


def learn(docs: DataFrame, path: str, per_language: int = TRAIN_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, and a table of piece probabilities by piece number and language."""

    def count_words():
        def step(langs, texts):
            counts = Counter()
            for lang, text in zip(langs.to_pylist(), texts.to_pylist()):
                counts.update((lang, w) for w in words_of(text or "") if len(w) <= TRAIN_LETTERS)
            rows = list(counts.items())
            columns = [[k[0] for k, _ in rows], [k[1] for k, _ in rows], [n for _, n in rows]]
            # Not by input row: nothing is kept.
            return pa.array([0] * len(rows), pa.int64()), [
                pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))
            ]

        return step

    sample = _sampled(docs, per_language)
    words = map_batches(sample, [], [F.col("lang"), F.col("text")], "lang string, word string, n bigint", count_words)
    words = materialize(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())  # one row per language
    pieces = len(Pieces(path).number)
    table = np.full((pieces, len(languages)), 1.0 / pieces)
    for _ in range(ROUNDS if languages else 0):
        found = _expected(words, path, languages, _with_unknown(table)).toArrow()  # a row per language and piece
        counts = np.full(table.shape, SMOOTHING)
        lang, piece = (found.column(c).to_numpy() for c in ("lang", "piece"))
        inside = piece < pieces
        counts[piece[inside], lang[inside]] += found.column("n").to_numpy()[inside]
        table = counts / counts.sum(axis=0)
    return languages, _with_unknown(table)


def _with_unknown(table: np.ndarray) -> np.ndarray:
    """The table with the rows of an unknown letter and of no piece."""
    columns = table.shape[1]
    return np.vstack([table, np.full((1, columns), UNKNOWN), np.zeros((1, columns))])


def _expected(words: DataFrame, path: str, languages: list[str], table: np.ndarray) -> DataFrame:
    def make():
        vocabulary = Pieces(path)
        size = len(vocabulary.number)
        place = {name: i for i, name in enumerate(languages)}

        def step(langs, texts, counts):
            langs, texts, counts = langs.to_pylist(), texts.to_pylist(), counts.to_numpy()
            total = np.zeros((len(languages), size + 2))
            for name in set(langs):
                own = [i for i, x in enumerate(langs) if x == name]
                column = table[:, place[name]]
                for group in by_length([texts[i] for i in own]):
                    rows = [own[g] for g in group]
                    lattice = vocabulary.lattice([texts[i] for i in rows])
                    total[place[name]] += expected_pieces(lattice, column, counts[rows], size)
            lang, piece = np.nonzero(total[:, : size + 1])
            return pa.array(np.zeros(len(lang), dtype=np.int64)), [
                pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[lang, piece])
            ]

        return step

    spread = words.repartition(max(8, words.sparkSession.sparkContext.defaultParallelism), "lang", "word")
    each = map_batches(spread, [], [F.col(c) for c in ("lang", "word", "n")], "lang int, piece int, n double", make)
    return each.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def predict(docs: DataFrame, keep: Sequence[str], path: str, languages: list[str], table: np.ndarray) -> DataFrame:
    """The kept columns, lang_pred and score, the share of the best language's probability."""

    def make():
        vocabulary = Pieces(path)
        kept = max(1, KEPT_CELLS // max(1, len(languages)))
        numbers: dict[str, int] = {}
        scores = [np.zeros((0, len(languages)))]

        def learn_words(new: list[str]) -> None:
            block = np.empty((len(new), len(languages)))
            for group in by_length(new):
                block[group] = forward(vocabulary.lattice([new[i] for i in group]), table)
            numbers.update(zip(new, range(len(numbers), len(numbers) + len(new))))
            scores[0] = np.vstack([scores[0], block])

        def step(texts):
            best, share = [], []
            if len(numbers) > kept:
                numbers.clear()
                scores[0] = scores[0][:0]
            found = [words_of(t) if t else [] for t in texts.to_pylist()]
            if languages:
                learn_words(list(dict.fromkeys(w for words in found for w in words if w not in numbers)))
            for words in found:
                if not words or not languages:
                    best.append(UNDETERMINED)
                    share.append(0.0)
                    continue
                whole = scores[0][[numbers[w] for w in words]].sum(axis=0)
                top = int(whole.argmax())
                best.append(languages[top])
                share.append(float(1.0 / np.exp(np.maximum(whole - whole[top], -700.0)).sum()))
            return None, [pa.array(best, pa.string()), pa.array(share, pa.float64())]

        return step

    return map_batches(docs, keep, [F.col("text")], "lang_pred string, score double", make)


def identify(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    path: str | None = None,
    per_language: int = TRAIN_PER_LANGUAGE,
) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Held-out rows teach nothing."""
    path = path or vocabulary_path()
    named = docs.select(
        quoted(doc_id).alias("doc_id"),
        quoted(text).alias("text"),
        quoted(lang).alias("lang"),
        in_fold(doc_id, HELD_OUT).alias("held_out"),
    )
    languages, table = learn(named, path, per_language)
    return predict(named, ["doc_id", "held_out"], path, languages, table)
