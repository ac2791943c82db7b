"""Ranked lexical search over bit-sliced Bloom signatures.

Index. Documents are taken in blocks. A document's terms set bits of a Bloom
signature whose width follows the number of its terms; the signatures of a block
with equal width are stored by slices: for each signature position a bitmap over
the documents. A term that occurs at least 2, 4, 8, ... times in a document sets
bits for those levels too.

Search. The bitmaps of a term's positions, and-ed, hold every document with the
term and a few others. A level bounds the term's occurrences from above, so the
weighted sum over an item's terms is an upper bound of a document's score.

1. The documents with the highest bounds are scored exactly. The score of the
   last one needed is the item's cutoff.
2. Documents whose bound is below the cutoff are excluded; all others are scored
   exactly from their texts, and the best are ranked.

Bounds and scores are 64-bit integers, so the order is exact.

Defined cases: a missing or empty text has no terms and is never ranked; an item
without known terms has no rows; rows of an item id that repeats are one item
with the terms of all; repeated documents are ranked one by one, equal ids in
any order; a missing id comes after all others of its score; empty tables give
no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from xxhash import xxh64_intdigest

from riskframe.llm.common import map_batches, quoted, whole_bytes
from riskframe.llm.decontaminate import search_words
from riskframe.session import materialize

BEST = 50
#: Signature positions a term sets, and positions kept per set bit.
HASHES = 3
ROOM = 5
#: Term occurrences are bounded at 2**level; the last level is open.
LEVELS = 6
NARROW, WIDE = 64, 1 << 30
#: Distinct terms of the items that are searched for at once.
BLOCK_TERMS = 200_000
#: Cells (terms or item terms x documents) of one table in a task.
CELLS = 1_000_000
SLICE_BYTES = 4 << 20
FACTOR = 1_000_000_000

_SIGNATURES = "positions int, lengths array<bigint>, slices binary"


def _positions(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """(terms, HASHES) places in a signature whose width is a power of two."""
    h = hashes + np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64)
    out = np.empty((len(hashes), HASHES), dtype=np.int64)
    for i in range(HASHES):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, i] = ((h ^ (h >> np.uint64(29))) & np.uint64(width - 1)).astype(np.int64)
    return out


def _width(keys: int) -> int:
    """Positions for a document's set bits: a power of two, ROOM to 2 * ROOM per bit."""
    return min(WIDE, max(NARROW, 1 << (keys * HASHES * ROOM - 1).bit_length()))


def _sliced(hashes: np.ndarray, counts: list[np.ndarray], terms: list[np.ndarray], width: int) -> bytes:
    """Slices of documents given by their terms' numbers and counts."""
    table = np.zeros((width, len(terms)), dtype=bool)
    for d, (own, n) in enumerate(zip(terms, counts)):
        for level in range(LEVELS):
            often = own[n >> level > 0]
            if not len(often):
                break
            table[_positions(hashes[often], level, width).ravel(), d] = True
    return np.packbits(table, axis=1).tobytes()


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: per block and width the documents' ids and lengths in terms, and the slices.

    Documents without terms are left out. A row holds the documents of one
    slice of a batch, so its size is bounded whatever the table's.
    """
    kind = docs.schema[doc_id].dataType
    result = T.StructType([T.StructField("ids", T.ArrayType(kind)), *T.StructType.fromDDL(_SIGNATURES).fields])

    def make():
        def step(ids, texts):
            vocabulary: dict[bytes, int] = {}
            by_width: dict[int, list] = {}
            for i, data in enumerate(texts.to_pylist()):
                words = search_words(data)
                if not words:
                    continue
                found = Counter(words)
                own = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in found), np.int64, len(found))
                n = np.fromiter(found.values(), np.int64, len(found))
                keys = sum(int((n >> level > 0).sum()) for level in range(LEVELS))
                by_width.setdefault(_width(keys), []).append((i, len(words), own, n))
            hashes = np.fromiter((xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
            rows, names, widths, lengths, slices = [], [], [], [], []
            for width, found in sorted(by_width.items()):
                step_by = max(1, 8 * CELLS // width)  # documents of one table
                for at in range(0, len(found), step_by):
                    part = found[at : at + step_by]
                    rows.append(0)
                    names.append(ids.take(pa.array([p[0] for p in part])).to_pylist())
                    widths.append(width)
                    lengths.append([p[1] for p in part])
                    slices.append(_sliced(hashes, [p[3] for p in part], [p[2] for p in part], width))
            return pa.array(rows, pa.int64()), [
                pa.array(names, pa.list_(ids.type)),
                pa.array(widths, pa.int32()),
                pa.array(lengths, pa.list_(pa.int64())),
                pa.array(slices, pa.binary()),
            ]

        return step

    return map_batches(docs, [], [quoted(doc_id), whole_bytes(text)], result, make, SLICE_BYTES)


class Items:
    """A block of items as numbers: term of each (item, term) pair, item by item."""

    def __init__(self, terms: Sequence[Sequence[bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        flat = [self.vocabulary.setdefault(t, len(self.vocabulary)) for own in terms for t in own]
        self.flat = np.array(flat, dtype=np.int64)
        self.sizes = np.array([len(own) for own in terms], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.weights = np.zeros(len(self.vocabulary), dtype=np.int64)
        self.documents = self.tokens = 0

    def weigh(self, documents: int, tokens: int, with_term: dict[int, int]) -> None:
        """Weights from the corpus: documents with terms, terms, documents by term."""
        self.documents, self.tokens = documents, tokens
        for term, df in with_term.items():
            self.weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """A document's m from its length in terms."""
        return 100 - 50 + np.array([50 * int(x) * self.documents // self.tokens for x in n], dtype=np.int64)

    def sums(self, parts: np.ndarray, items: np.ndarray | None = None) -> np.ndarray:
        """Sums of the terms' rows of ``parts`` for each item (of those given)."""
        if items is None:
            return np.add.reduceat(parts[self.flat], self.starts, axis=0)
        sizes = self.sizes[items]
        ends = np.cumsum(sizes)
        flat = np.repeat(self.starts[items] - (ends - sizes), sizes) + np.arange(ends[-1])
        return np.add.reduceat(parts[self.flat[flat]], ends - sizes, axis=0)


def _share(tf, m):
    """The integer part of a term's score before its weight."""
    return (FACTOR * tf) // (1000 * tf + 20 * m)


def _bounds(items: Items, hashes: np.ndarray, row: dict):
    """(first document, upper bounds by item and document) for parts of an index row."""
    width, lengths = row["positions"], np.array(row["lengths"], dtype=np.int64)
    slices = np.frombuffer(row["slices"], dtype=np.uint8).reshape(width, -1)
    present = np.full((len(hashes), slices.shape[1]), 255, dtype=np.uint8)
    levels = []  # per level: terms that any document may hold so often, and their bitmaps
    terms = np.arange(len(hashes))
    for level in range(LEVELS):
        for column in _positions(hashes[terms], level, width).T:
            present = present & slices[column]
        some = present.any(axis=1)
        terms, present = terms[some], present[some]
        if not len(terms):
            break
        levels.append((terms, present))
    m = items.lengths(lengths)
    height = max(8, CELLS // max(1, len(items.flat)) // 8 * 8)
    for at in range(0, len(lengths), height):
        n, own = lengths[at : at + height], m[at : at + height]
        best = np.zeros((len(hashes), len(n)), dtype=np.int64)
        for level, (terms, bitmaps) in enumerate(levels):
            most = np.minimum(n, (2 << level) - 1) if level < LEVELS - 1 else n
            held = np.unpackbits(bitmaps[:, at // 8 : (at + height) // 8], axis=1)[:, : len(n)].astype(bool)
            # Fewer occurrences never give more, so a higher level's bound replaces a lower one's.
            best[terms] = np.where(held, _share(most, own)[None, :], best[terms])
        yield at, items.sums(best * items.weights[:, None])


def _rows(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


_PAIR = "item int, bound bigint"


def highest_bounds(index: DataFrame, items: Items, best: int) -> DataFrame:
    """Per partition and item the documents with the highest bounds: id, item, bound."""
    hashes = np.array([xxh64_intdigest(t) for t in items.vocabulary], dtype=np.uint64)
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL(_PAIR).fields])
    number = len(items.sizes)

    def run(batches):
        ids, kind = [], None
        bounds = np.zeros((number, 0), dtype=np.int64)
        places = np.zeros((number, 0), dtype=np.int64)
        for batch in batches:
            kind = batch.schema.field(0).type.value_type
            for row in _rows(batch):
                for at, own in _bounds(items, hashes, row):
                    bounds = np.concatenate([bounds, own], axis=1)
                    here = np.arange(len(ids) + at, len(ids) + at + own.shape[1])
                    places = np.concatenate([places, np.broadcast_to(here, own.shape)], axis=1)
                    if bounds.shape[1] > best:
                        top = np.argpartition(-bounds, best - 1, axis=1)[:, :best]
                        bounds, places = np.take_along_axis(bounds, top, 1), np.take_along_axis(places, top, 1)
                ids.extend(row["ids"])
        if kind is not None:
            item, column = np.nonzero(bounds > 0)
            chosen = places[item, column].tolist()
            columns = [pa.array([ids[p] for p in chosen], kind), pa.array(item.astype(np.int32)), pa.array(bounds[item, column])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "item", "bound"])

    return index.mapInArrow(run, schema)


def not_excluded(index: DataFrame, items: Items, cutoffs: np.ndarray) -> DataFrame:
    """id and items of every document whose bound reaches an item's cutoff."""
    hashes = np.array([xxh64_intdigest(t) for t in items.vocabulary], dtype=np.uint64)
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("items", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            kind = batch.schema.field(0).type.value_type
            for row in _rows(batch):
                ids, asked = [], []
                for at, bounds in _bounds(items, hashes, row):
                    document, item = np.nonzero((bounds >= cutoffs[:, None]).T)
                    cut = np.flatnonzero(np.diff(document)) + 1
                    for d, own in zip(document[np.concatenate([[0], cut])] if len(document) else [], np.split(item, cut)):
                        ids.append(row["ids"][at + d])
                        asked.append(own.astype(np.int32))
                columns = [pa.array(ids, kind), pa.array(asked, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "items"])

    return index.mapInArrow(run, schema)


def exact_scores(docs: DataFrame, asked: DataFrame, items: Items) -> DataFrame:
    """id, item, score above 0 of the documents (id, data) for the items asked of each."""
    kind = docs.schema["id"].dataType
    asked = asked.select(F.col("id").alias("asked_id"), "items")
    both = docs.join(asked, F.col("id").eqNullSafe(F.col("asked_id"))).select("id", "data", "items")

    def make():
        vocabulary = items.vocabulary

        def step(texts, wanted):
            rows, names, scores = [], [], []
            shares = np.zeros(len(vocabulary), dtype=np.int64)
            for i, data in enumerate(texts.to_pylist()):
                words = search_words(data)
                found = Counter(w for w in words if w in vocabulary)
                own = wanted[i].values.to_numpy() if words else []
                if not found or not len(own):
                    continue
                place = np.fromiter((vocabulary[w] for w in found), np.int64, len(found))
                tf = np.fromiter(found.values(), np.int64, len(found))
                shares[place] = items.weights[place] * _share(tf, items.lengths([len(words)])[0])
                total = items.sums(shares, own)
                shares[place] = 0
                rows.append(np.full(len(own), i))
                names.append(own)
                scores.append(total)
            flat = [np.concatenate([np.empty(0, dtype=t), *x]) for x, t in ((rows, "i8"), (names, "i4"), (scores, "i8"))]
            good = flat[2] > 0
            return pa.array(flat[0][good]), [pa.array(flat[1][good].astype(np.int32)), pa.array(flat[2][good])]

        return step

    found = map_batches(both, ["id"], [F.col("data"), F.col("items")], "item int, score bigint", make, SLICE_BYTES)
    assert found.schema["id"].dataType == kind
    return found


def _document_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> dict[int, int]:
    """Documents that hold each asked term, by term number: one row per term comes back."""

    def make():
        def step(texts):
            counts: Counter[int] = Counter()
            for data in texts.to_pylist():
                counts.update({vocabulary[w] for w in search_words(data) if w in vocabulary})
            return pa.array([0] * len(counts), pa.int64()), [
                pa.array(list(counts), pa.int32()),
                pa.array(list(counts.values()), pa.int64()),
            ]

        return step

    found = map_batches(docs, [], [F.col("data")], "term int, n bigint", make, SLICE_BYTES)
    return {r["term"]: r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, terms): distinct terms of all rows of an item."""

    def make():
        def step(texts):
            return None, [pa.array([sorted(set(search_words(t))) for t in texts.to_pylist()], pa.list_(pa.binary()))]

        return step

    named = items.select(quoted(item_id).alias("item_id"), whole_bytes(text).alias("text"))
    rows = map_batches(named, ["item_id"], [F.col("text")], "terms array<binary>", make)
    terms = F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms"))))
    return rows.groupBy("item_id").agg(terms.alias("terms"))


def search(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    index: DataFrame | None = None,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Each item's best documents: item_id, rank, doc_id, score.

    ``index`` may be a stored result of ``signatures`` for the same documents.
    Items are searched for in blocks of about ``block_terms`` terms, each with
    two scans of the index; only a block's terms and cutoffs go to the tasks.
    """
    spark = docs.sparkSession
    index = materialize(signatures(docs, doc_id, text), "signatures") if index is None else index
    lengths = F.explode("lengths").alias("n")
    documents, tokens = index.select(lengths).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    texts = docs.select(quoted(doc_id).alias("id"), whole_bytes(text).alias("data"))
    terms = materialize(_item_terms(items, item_id, item_text).where(F.size("terms") > 0), "items")
    total = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = -(-total // block_terms) if documents else 0
    placed = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = Window.partitionBy("item").orderBy(*order)
    highest = Window.partitionBy("item").orderBy(F.desc("bound"))
    found = []
    for block in range(blocks):
        own = placed.where(F.col("block") == block).select("item_id", "terms").toArrow()
        if not own.num_rows:
            continue
        numbers = Items(own.column("terms").to_pylist())
        numbers.weigh(documents, tokens, _document_counts(texts, numbers.vocabulary))
        # 1. Cutoffs from the documents with the highest bounds.
        near = (
            highest_bounds(index, numbers, best)
            .withColumn("place", F.row_number().over(highest))
            .where(F.col("place") <= best)
            .groupBy("id")
            .agg(F.collect_set("item").alias("items"))
        )
        known = exact_scores(texts, materialize(near, "highest"), numbers)
        known = known.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
        lows = known.where(F.col("place") == best).select("item", "score").collect()  # one row per item
        cutoffs = np.ones(len(numbers.sizes), dtype=np.int64)
        for row in lows:
            cutoffs[row["item"]] = max(1, row["score"])
        # 2. Exact scores of all that are not excluded.
        left = materialize(not_excluded(index, numbers, cutoffs), "not-excluded")
        # Rows of one id come together once, with each item once.
        asked = left.select("id", F.explode("items").alias("item")).distinct()
        asked = asked.groupBy("id").agg(F.collect_list("item").alias("items"))
        scored = exact_scores(texts, materialize(asked, "asked"), numbers).withColumnRenamed("id", "doc_id")
        top = scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= best)
        names = own.select(["item_id"]).append_column("item", pa.array(range(own.num_rows), pa.int32()))
        named = top.join(F.broadcast(spark.createDataFrame(names)), "item")  # one row per item of the block
        found.append(materialize(named.select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not found:
        kinds = {"item_id": items.schema[item_id].dataType, "doc_id": docs.schema[doc_id].dataType}
        fields = [("item_id", kinds["item_id"]), ("rank", T.IntegerType()), ("doc_id", kinds["doc_id"]), ("score", T.LongType())]
        return spark.createDataFrame([], T.StructType([T.StructField(n, k) for n, k in fields]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
