"""Quality by co-training of a text view and a metadata view.

The text view sees how the text is written: the forms of its words (runs of
letters, capitals, digits and marks), repeats and proportions. The metadata view
sees the row's source, language and length. Each view is a logistic regression
trained on labelled rows and on the rows of an unlabelled pool that the other view
is sure of; over several rounds they exchange such pseudo-labels. Both are then
calibrated, combined, and score every document. Calibration is cross-fitted: each
part of the labelled rows is judged by models trained on the other parts, so all
labels train and all labels calibrate, however few they are.

The labelled sample and the pool are bounded by parameters; scoring covers all
rows in one pass without a shuffle.

Defined cases: a missing or empty text has the features of no words; missing
metadata is a value of its own, missing columns are left out; labels that are
missing teach nothing; without labels of both kinds the score is the share of
good ones (one half without labels); repeated rows are scored each; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import in_fold, map_batches, quoted
from riskframe.llm.toxicity import best_threshold, labelled_sample

HELD_OUT = 0
#: Labelled rows of low and of good quality, and rows of the unlabelled pool, about.
TRAIN_LOW, TRAIN_GOOD, POOL = 2_000, 4_000, 6_000
#: Parts of the labelled sample; each is judged by models that the others trained.
PARTS = 4
ROUNDS = 5
#: Pseudo-labels that a view hands over per round and kind, at this calibrated chance or more.
HANDED, SURE = 200, 0.95
FORMS, FACTS = 256, 128
PROPORTIONS = 10
PENALTY = 2.0
SEED = 42
KEPT_WORDS = 300_000
_CLASSES = re.compile(r"([^\W\d_]+)|(\d+)|(.)", re.S)


def word_form(word: str) -> tuple[int, int, int, int, int]:
    """(bucket of the form, letters, capitals, digits, marks) of a word.

    A form writes runs of letters as ``a``, ``A`` (all capitals) or ``Aa``,
    digits as ``0`` and repeated marks once.
    """
    form, letters, capitals, digits, marks = [], 0, 0, 0, 0
    for run, number, mark in _CLASSES.findall(word):
        if run:
            upper = sum(c.isupper() for c in run)
            form.append("A" if upper == len(run) > 1 else "Aa" if upper else "a")
            letters, capitals = letters + len(run), capitals + upper
        elif number:
            form.append("0")
            digits += len(number)
        else:
            if not form or form[-1] != mark:
                form.append(mark)
            marks += 1
    return zlib.crc32("".join(form).encode()) % FORMS, letters, capitals, digits, marks


class TextView:
    """Features of a text; forms of words are kept within a task."""

    def __init__(self) -> None:
        self.forms: dict[str, tuple[int, int, int, int, int]] = {}

    def features(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        out = np.zeros(FORMS + PROPORTIONS)
        n = len(words)
        if not n:
            return out
        forms = self.forms
        if len(forms) > KEPT_WORDS:
            forms.clear()
        for word in set(words):
            if word not in forms:
                forms[word] = word_form(word)
        table = np.array([forms[w] for w in words])
        out[:FORMS] = np.log1p(100 * np.bincount(table[:, 0], minlength=FORMS) / n)
        letters, capitals, digits, marks = table[:, 1:].sum(axis=0)
        total = letters + digits + marks
        lines = text.split("\n")
        out[FORMS:] = (
            len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            capitals / max(1, letters),
            digits / max(1, total),
            marks / max(1, total),
            math.log1p(total / n),
            math.log1p(n),
            math.log1p(n / len(lines)),
            1 - len(set(lines)) / len(lines),
            math.log1p(np.bincount(np.unique(table[:, 0])).sum()),
        )
        return out


def fact_features(facts: Sequence[tuple[str, object]]) -> np.ndarray:
    """Hashed name=value pairs; numbers are cut into half octaves."""
    out = np.zeros(FACTS)
    for name, value in facts:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            value = round(2 * math.log2(value + 1)) if math.isfinite(value) and value > 0 else 0
        out[zlib.crc32(f"{name}={value}".encode()) % FACTS] = 1.0
    return out


@dataclass
class Logistic:
    """Logistic regression with a quadratic penalty, by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(
        cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, near: Logistic | None = None
    ) -> Logistic:
        """``near``: a model of similar rows, whose scale is kept and whose weights the steps start from."""
        mean, scale = (near.mean, near.scale) if near else (x.mean(axis=0), np.maximum(x.std(axis=0), 0.05))
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w = near.weights.copy() if near else np.zeros(z.shape[1])
        ridge = np.full(len(w), penalty)
        ridge[-1] = 1e-3
        for _ in range(15):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (weight * (p - y)) + ridge * w
            curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(curve, gradient)
            w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logits(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]
        return self.slope * raw + self.shift

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        """A logistic line from raw logits, of models like this one, to the label."""
        self.slope, self.shift = 1.0, 0.0
        if len(y) and 0 < y.sum() < len(y):
            line = Logistic.fit(raw[:, None], y, np.ones(len(y)), 1e-2)
            self.slope = float(line.weights[0] / line.scale[0])
            self.shift = float(line.weights[1] - line.weights[0] * line.mean[0] / line.scale[0])


def _parts(y: np.ndarray) -> np.ndarray:
    """The part of each labelled row; both labels are dealt evenly."""
    out = np.zeros(len(y), dtype=np.int64)
    draw = np.random.default_rng(SEED)
    for label in (0, 1):
        own = draw.permutation(np.flatnonzero(y == label))
        out[own] = np.arange(len(own)) % PARTS
    return out


def _cross_fitted(whole: Logistic, view: np.ndarray, y: np.ndarray, part: np.ndarray, more: np.ndarray, labels) -> np.ndarray:
    """Raw logits of the labelled rows, each by a model that its own part did not train."""
    raw = np.zeros(len(y))
    for p in range(PARTS):
        rest = part != p
        target = np.concatenate([y[rest], labels])
        if not 0 < target.sum() < len(target):
            raw[~rest] = whole.logits(view[~rest])
            continue
        model = Logistic.fit(np.vstack([view[rest], more]), target, np.ones(len(target)), near=whole)
        raw[~rest] = model.logits(view[~rest])
    return raw


@dataclass
class CoTrained:
    """Both views, how they are added, and the logit that stands for one half."""

    text: Logistic | None = None
    facts: Logistic | None = None
    share: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))
    threshold: float = 0.0
    constant: float = 0.5

    def logits(self, text: np.ndarray, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, facts, combined) logits."""
        a, b = self.text.logits(text), self.facts.logits(facts)
        return a, b, self.share[0] * a + self.share[1] * b + self.share[2] - self.threshold


def co_train(
    text: np.ndarray, facts: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_facts: np.ndarray
) -> CoTrained:
    """Views trained on labelled rows and on the pseudo-labels that they hand each other."""
    if len(y) == 0 or y.min() == y.max():
        return CoTrained(constant=float(y.mean()) if len(y) else 0.5)
    part = _parts(y)
    views, pools = [text, facts], [pool_text, pool_facts]
    # What each view has been handed by the other: rows of the pool and their labels.
    handed: list[tuple[list[int], list[int]]] = [([], []), ([], [])]
    models: list[Logistic] = []
    judged: list[np.ndarray] = []
    for turn in range(ROUNDS + 1):
        models, judged = [], []
        for view, pool, (rows, labels) in zip(views, pools, handed):
            more = pool[rows] if rows else view[:0]
            target = np.concatenate([y, labels])
            model = Logistic.fit(np.vstack([view, more]), target, np.ones(len(target)))
            raw = _cross_fitted(model, view, y, part, more, labels)
            model.calibrate(raw, y)
            models.append(model)
            judged.append(model.slope * raw + model.shift)
        if turn == ROUNDS or not len(pool_text):
            break
        for giver, receiver in ((0, 1), (1, 0)):
            chance = 1 / (1 + np.exp(-np.clip(models[giver].logits(pools[giver]), -30, 30)))
            rows, labels = handed[receiver]
            fresh = np.setdiff1d(np.arange(len(chance)), rows)
            for label, sure in ((1, chance), (0, 1 - chance)):
                able = fresh[sure[fresh] >= SURE]
                # Kinds in the proportion of the labels.
                most = max(1, round(HANDED * float((y == label).mean())))
                best = able[np.argsort(-sure[able], kind="stable")][:most]
                rows.extend(best.tolist())
                labels.extend([label] * len(best))
    out = CoTrained(models[0], models[1])
    both = Logistic.fit(np.column_stack(judged), y.astype(float), np.ones(len(y)), 1e-2)
    w = both.weights[:2] / both.scale
    out.share = np.array([w[0], w[1], both.weights[2] - (w * both.mean).sum()])
    combined = out.share[0] * judged[0] + out.share[1] * judged[1] + out.share[2]
    # The threshold is the best one for finding the low ones.
    out.threshold = -best_threshold(-combined, 1 - y)
    return out


def _features(docs: DataFrame, keep: Sequence[str], text: str, facts: Sequence[str]) -> DataFrame:
    def make():
        view = TextView()

        def step(texts, *columns):
            rows = [view.features(t) for t in texts.to_pylist()]
            named = [fact_features(list(zip(facts, row))) for row in zip(*[c.to_pylist() for c in columns])]
            named = named or [fact_features([])] * len(rows)
            return None, [pa.array([list(r) for r in part], pa.list_(pa.float32())) for part in (rows, named)]

        return step

    inputs = [quoted(c) for c in (text, *facts)]
    return map_batches(docs, keep, inputs, "text_view array<float>, fact_view array<float>", make)


def _table(column, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(-1, width)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    facts: Sequence[str] = ("source", "lang", "n_chars"),
    label: str = "quality",
    held_out: int = HELD_OUT,
    most: Sequence[int] = (TRAIN_LOW, TRAIN_GOOD),
    pool_rows: int = POOL,
) -> CoTrained:
    facts = [c for c in facts if c in docs.columns]
    names = ["text", *[f"f{i}" for i in range(len(facts))]]
    columns = [quoted(c) for c in (text, *facts)]
    taught = labelled_sample(docs, labels, doc_id, label, held_out, most, columns)
    taught = taught.select("id", "y", *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
    rows = _features(taught, ["id", "y"], "text", names[1:]).orderBy("id").toArrow()  # bounded by ``most``
    width = FORMS + PROPORTIONS
    # The pool: rows without a label, drawn by their id.
    free = docs.where(quoted(doc_id).isNotNull() & ~in_fold(doc_id, held_out))
    share = pool_rows / max(1, docs.count())
    draw = F.pmod(F.xxhash64(quoted(doc_id), F.lit("pool")), F.lit(1 << 30)) / float(1 << 30)
    free = free.where(draw < share).select(quoted(doc_id).alias("id"), *[c.alias(n) for c, n in zip(columns, names)])
    known = labels.where(quoted(label).isNotNull()).select(quoted(doc_id).alias("id"))
    pool = _features(free.join(known, "id", "left_anti"), ["id"], "text", names[1:]).orderBy("id").toArrow()
    y = np.array(rows.column("y").to_pylist(), dtype=np.int64)
    return co_train(
        _table(rows.column("text_view"), width), _table(rows.column("fact_view"), FACTS), y,
        _table(pool.column("text_view"), width), _table(pool.column("fact_view"), FACTS),
    )


RESULT = "score double, predicted int, text_score double, fact_score double"


def score_texts(docs: DataFrame, keep: Sequence[str], text: str, facts: Sequence[str], model: CoTrained) -> DataFrame:
    """The kept columns, score (0 to 1, higher: better), predicted, and each view's calibrated chance."""
    facts = [c for c in facts if c in docs.columns]

    def make():
        view = TextView()

        def step(texts, *columns):
            n = len(texts)
            if model.text is None:
                chances = [np.full(n, model.constant)] * 3
            else:
                named = [c.to_pylist() for c in columns]
                x = np.array([view.features(t) for t in texts.to_pylist()])
                z = np.array([fact_features([(f"f{i}", c[k]) for i, c in enumerate(named)]) for k in range(n)])
                chances = [1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in model.logits(x, z)]
            first, second, whole = chances
            return None, [
                pa.array(whole), pa.array((whole >= 0.5).astype(np.int32)), pa.array(first), pa.array(second)
            ]

        return step

    return map_batches(docs, keep, [quoted(c) for c in (text, *facts)], RESULT, make)


FACT_COLUMNS = ("source", "lang", "n_chars")


def score_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", facts: Sequence[str] = FACT_COLUMNS
) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, text_score, fact_score."""
    model = learn(docs, labels, doc_id, text, facts)
    facts = [c for c in facts if c in docs.columns]
    named = docs.select(
        quoted(doc_id).alias("doc_id"),
        in_fold(doc_id, HELD_OUT).alias("held_out"),
        quoted(text).alias("text"),
        *[quoted(c).alias(f"f{i}") for i, c in enumerate(facts)],
    )
    return score_texts(named, ["doc_id", "held_out"], "text", [f"f{i}" for i in range(len(facts))], model)


def good_documents(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", facts: Sequence[str] = FACT_COLUMNS
) -> DataFrame:
    """The documents that are predicted good, columns unchanged."""
    columns = docs.columns
    scored = score_texts(docs, columns, text, facts, learn(docs, labels, doc_id, text, facts))
    kept = [f"c{i}" for i in range(len(columns))]
    plain = scored.toDF(*kept, "score", "predicted", "text_score", "fact_score")
    return plain.where("predicted = 1").select(*kept).toDF(*columns)
