"""Long repeated byte strings by a logarithmic family of suffix arrays.

Texts are indexed in batches. A batch gets a suffix array: its suffixes in order
of their leading bytes, each with a digest of the bytes it must share to lie in
a match, and how many places hold it. The array is merge-scanned against every
array of the family, then joins the family; two arrays of equal size are merged
into one of the next size, so n batches leave at most log2(n) + 1 arrays. Arrays
are bucketed and sorted alike, so scans and merges move no rows between tasks.

The arrays are sparse: of ``window - 7`` neighbouring places the one whose eight
bytes have the smallest hash is indexed (its *anchor*). A string of ``length``
bytes takes its anchor from its first ``window`` bytes, so equal strings have
their anchors at the same place, and share the ``length - window + 8`` bytes from
the anchor on, its *context*. About two suffixes per window are kept, not all.

An anchor owns a run of neighbouring strings. Only places whose context the
scans found elsewhere are looked at again. Places whose whole runs are equal
form a class; a class of several is a match as it stands. Classes of one context
that differ as a whole are compared by cells of strings: a cell whose text
recurs is a match, a cell whose common core does not recur holds none, and only
cells between the two are compared string by string.

Texts are written once and stay where they lie: what is found about them is
shuffled to their files. Equality is that of 64-bit digests inside groups of
equal contexts.

Defined cases: a missing or empty text has no bytes; texts shorter than
``length`` are never touched; repeated rows are documents of their own, so a
repeated long text goes wholly; a missing id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from riskframe.llm.common import binary_parts, map_batches, quoted, remove, whole_bytes, with_number
from riskframe.operators.keyed import attach_by_key
from riskframe.session import materialize, new_shared_path, write_shared

LENGTH = 400
#: A string takes its anchor from its first WINDOW bytes.
WINDOW = 288
GRAM = 8
#: Batches that one call of ``remove_repeats`` makes of a table.
BATCHES = 4
#: Neighbouring strings that are compared as one.
CELL = 16
#: Places hashed at once.
PLACES = 1 << 18
SLICE_BYTES = 2 << 20

#: A text's file and its number.
TEXT = ["part", "number"]
ENTRY = "anchor int, first int, last int, context bigint, whole bigint"
CLASS = ["context", "whole"]


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _grams(data: np.ndarray, first: int, last: int) -> np.ndarray:
    """The eight bytes from each place of [first, last), zeros behind the data."""
    part = data[first : last + GRAM]
    padded = np.zeros(-(-(last - first + GRAM) // 8) * 8 + GRAM, dtype=np.uint8)
    padded[: len(part)] = part
    out = np.empty(-(-(last - first) // GRAM) * GRAM, dtype="<u8")
    for shift in range(GRAM):
        own = padded[shift : shift + len(out)].view("<u8")
        out[shift::GRAM] = own
    return out[: last - first]


def _hashed(grams: np.ndarray) -> np.ndarray:
    """The upper 32 bits of a mixed hash, in place of the upper half of 64."""
    h = grams * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h & np.uint64(0xFFFFFFFF00000000)


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours: minima from block ends meet minima from block starts."""
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, window: int = WINDOW):
    """(document, anchor, first, last) of every run of strings with one anchor, as places in ``data``."""
    places = window - GRAM + 1  # an anchor's eight bytes lie inside the window
    found = []
    for at in range(0, len(data), PLACES):
        end = min(len(data), at + PLACES)  # strings starting in [at, end)
        last = min(len(data), end + places - 1)
        keys = _hashed(_grams(data, at, last)) | np.arange(last - at, dtype=np.uint64)
        if len(keys) < places:
            break
        smallest = (_smallest(keys, places) & np.uint64(0xFFFFFFFF)).astype(np.int64) + at
        cut = np.flatnonzero(np.diff(smallest)) + 1
        starts = np.concatenate([[0], cut])
        ends = np.concatenate([cut, [len(smallest)]]) - 1
        found.append(np.stack([smallest[starts], starts + at, ends + at]))
    if not found:
        return [np.empty(0, dtype=np.int64)] * 4
    anchor, first, last = np.concatenate(found, axis=1)
    # A run cut where places were dealt is one run again.
    same = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (first[1:] == last[:-1] + 1)])
    head = np.flatnonzero(~same)
    anchor, first = anchor[head], first[head]
    last = last[np.concatenate([head[1:], [len(same)]]) - 1]
    # Strings end inside their document.
    limits = offsets[1:] - length
    doc = np.searchsorted(offsets[1:], first, side="right")
    pieces = [(doc, anchor, first, np.minimum(last, limits[np.minimum(doc, len(limits) - 1)]))]
    # A run may go on in later documents: its anchor lies there, so only its last document counts.
    late = np.searchsorted(offsets[1:], last, side="right")
    more = late > doc
    if more.any():
        d = late[more]
        pieces.append((d, anchor[more], np.maximum(first[more], offsets[d]), np.minimum(last[more], limits[d])))
    doc, anchor, first, last = (np.concatenate(x) for x in zip(*pieces))
    good = (last >= first) & (first >= offsets[doc])
    order = np.argsort(first[good], kind="stable")
    return [x[good][order] for x in (doc, anchor, first, last)]


def index_entries(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """``TEXT`` and ``ENTRY`` of every indexed suffix of (part, number, data).

    ``context`` leads with the suffix's first four bytes, so it sorts as the suffixes do.
    """
    shared = length - window + GRAM

    def make():
        def step(texts):
            data, offsets = binary_parts(texts)
            doc, anchor, first, last = anchors(data, offsets, length, window)
            view = memoryview(data)
            context = [
                (int.from_bytes(view[a : a + 4], "big") << 32 | xxh64_intdigest(view[a : a + shared]) >> 32) - (1 << 63)
                for a in anchor.tolist()
            ]
            whole = [
                xxh3_64_intdigest(view[s : e + length], (a - s) << 16 | (e - s))
                for a, s, e in zip(anchor.tolist(), first.tolist(), last.tolist())
            ]
            base = offsets[doc]
            own = [pa.array((x - base).astype(np.int32)) for x in (anchor, first, last)]
            return pa.array(doc), [*own, pa.array(context, pa.int64()), pa.array(_signed(whole))]

        return step

    return map_batches(docs.where(F.length("data") >= length), TEXT, [F.col("data")], ENTRY, make, SLICE_BYTES)


class Bucketed:
    """A table of the session's own folder, bucketed by one column."""

    def __init__(self, df: DataFrame, name: str, key: str, sort: bool = False, split: Sequence[str] = ()):
        self.spark = df.sparkSession
        self.name, self.path = f"riskframe_{name}_{uuid.uuid4().hex}", new_shared_path(self.spark, name)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = df.write.bucketBy(buckets, key).option("path", self.path).option("compression", "zstd")
        writer = writer.partitionBy(*split) if split else writer
        (writer.sortBy(key) if sort else writer).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        remove(self.spark, self.path)


def suffix_array(entries: DataFrame) -> DataFrame:
    """(context, n): distinct contexts and their places, summed before they are shuffled."""
    return entries.groupBy("context").agg(F.count(F.lit(1)).alias("n"))


def merged(arrays: list[DataFrame]) -> DataFrame:
    """One array of several: joins of sorted buckets, as a grouped union of buckets would be dealt anew or worse."""
    rows = arrays[0]
    for more in arrays[1:]:
        own = more.select(F.col("context").alias("other"), F.col("n").alias("more"))
        both = rows.join(own, F.col("context") == F.col("other"), "full")
        total = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
        rows = both.select(F.coalesce("context", "other").alias("context"), total.alias("n"))
    return rows


def long_matches(array: DataFrame, family: list[DataFrame]) -> DataFrame:
    """Merge-scan: the contexts of ``array`` with several places, in it or in the family."""
    known = F.col("n") > 1
    for i, level in enumerate(family):
        array = array.join(level.select("context", F.lit(True).alias(f"met{i}")), "context", "left")
        known = known | F.coalesce(F.col(f"met{i}"), F.lit(False))
    return array.where(known).select("context")


def _all(tables: list[DataFrame]) -> DataFrame:
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    return rows


class Family:
    """Arrays by size: ``levels[i]`` holds 2**i batches or is empty."""

    def __init__(self) -> None:
        self.levels: list[Bucketed | None] = []
        self.found: list[DataFrame] = []

    def arrays(self) -> list[DataFrame]:
        return [x.rows for x in self.levels if x is not None]

    def add(self, entries: DataFrame) -> None:
        """Scan a batch's array against the family, then merge it in."""
        new = Bucketed(suffix_array(entries), "array", "context", sort=True)
        self.found.append(materialize(long_matches(new.rows, self.arrays()), "found"))
        level, carried = 0, [new]
        while level < len(self.levels) and self.levels[level] is not None:
            carried.append(self.levels[level])
            self.levels[level] = None
            level += 1
        if level == len(self.levels):
            self.levels.append(None)
        # Carries meet in one merge: no array is written to be merged again at once.
        self.levels[level] = new
        if len(carried) > 1:
            self.levels[level] = Bucketed(merged([x.rows for x in carried]), "array", "context", sort=True)
            for old in carried:
                old.drop()

    def contexts(self) -> DataFrame:
        """(context, n) of every context with several places."""
        return merged(self.arrays()).join(_all(self.found).distinct(), "context", "left_semi")

    def drop(self) -> None:
        for level in self.levels:
            if level is not None:
                level.drop()


@contextmanager
def _beside_texts(spark: SparkSession) -> Iterator[None]:
    """Joins by file and number leave the texts in the files' buckets."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _window_rows(docs: DataFrame, wanted: DataFrame, result: str, make, name: str) -> DataFrame:
    """Rows made from the texts that ``wanted`` names, all of a text's at once."""
    columns = [c for c in wanted.columns if c not in TEXT]
    per_text = materialize(wanted.groupBy(*TEXT).agg(F.collect_list(F.struct(*columns)).alias("wanted")), "wanted")
    both = docs.select(*TEXT, "data").join(per_text, TEXT)
    rows = map_batches(both, TEXT, [F.col("data"), F.col("wanted")], result, make, SLICE_BYTES)
    with _beside_texts(docs.sparkSession):
        return materialize(rows, name)


def _columns(kinds: str) -> list[array]:
    return [array(k) for k in kinds]


def _cells(length: int):
    """Per wanted run and cell: digests of the cell's core and of its whole text."""

    def make():
        def step(texts, wanted):
            rows, context, cells, cores, wholes, known, places, single = out = _columns("qqqQQbqb")
            for i, (data, runs) in enumerate(zip(texts, wanted.to_pylist())):
                view = memoryview(data.as_buffer())
                starts = len(view) - length  # the last string
                for run in runs:
                    anchor = run["anchor"]
                    for cell in range((anchor - run["last"]) // CELL, (anchor - run["first"]) // CELL + 1):
                        low, high = anchor - cell * CELL - CELL + 1, anchor - cell * CELL  # first bytes of its strings
                        inside = low >= 0 and high <= starts
                        rows.append(i)
                        context.append(run["context"])
                        cells.append(cell)
                        cores.append(xxh64_intdigest(view[high : low + length]))
                        wholes.append(xxh3_64_intdigest(view[low : high + length]) if inside else 0)
                        known.append(inside)
                        places.append(anchor)
                        single.append(run["single"])
            rows, context, cells, cores, wholes, known, places, single = (np.array(x) for x in out)
            return pa.array(rows), [
                pa.array(context),
                pa.array(cells.astype(np.int32)),
                pa.array(cores.view(np.int64)),
                pa.array(wholes.view(np.int64), mask=known == 0),
                pa.array(places.astype(np.int32)),
                pa.array(single.astype(bool)),
            ]

        return step

    return make


def _strings(length: int):
    """Per wanted cell and string: its first byte and digest."""

    def make():
        def step(texts, wanted):
            rows, context, offsets, digests, lows, single = out = _columns("qqqQqb")
            for i, (data, cells) in enumerate(zip(texts, wanted.to_pylist())):
                view = memoryview(data.as_buffer())
                for c in cells:
                    top = c["anchor"] - c["cell"] * CELL
                    for low in range(max(0, top - CELL + 1), min(top, len(view) - length) + 1):
                        rows.append(i)
                        context.append(c["context"])
                        offsets.append(c["anchor"] - low)
                        digests.append(xxh64_intdigest(view[low : low + length]))
                        lows.append(low)
                        single.append(c["single"])
            rows, context, offsets, digests, lows, single = (np.array(x) for x in out)
            return pa.array(rows), [
                pa.array(context),
                pa.array(offsets.astype(np.int32)),
                pa.array(digests.view(np.int64)),
                pa.array(lows.astype(np.int32)),
                pa.array(single.astype(bool)),
            ]

        return step

    return make


def partial_matches(docs: DataFrame, classes: DataFrame, length: int = LENGTH) -> DataFrame:
    """``TEXT``, low, high: bytes of strings that recur although their runs do not.

    One member stands for each class, so copies cost nothing here. Cells and
    strings are counted by digest after a map-side sum; those that recur go back
    to their rows in slices of their own count.
    """
    contexts = (
        classes.groupBy("context")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") == 1).alias("singles"))
        .where("n > 1 and singles > 0")
        .select("context", "n")
    )
    runs = classes.withColumn("single", F.col("n") == 1).select("context", "member", "single")
    runs = attach_by_key(runs, materialize(contexts, "contexts"), "context").select("context", "member.*", "single")
    cells = "context bigint, cell int, core bigint, text bigint, anchor int, single boolean"
    cells = _window_rows(docs, runs, cells, _cells(length), "cells")
    cell_key = ["context", "cell", "core"]
    # A cell at a text's end has no whole text: its strings are always looked at.
    kinds = materialize(
        cells.groupBy(*cell_key, "text").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("single").alias("singles"),
            F.min(F.struct(*TEXT, "anchor")).alias("member"),
        ),
        "cell-kinds",
    )
    again = kinds.where("n > 1 and text is not null and singles > 0").select("context", "cell", "text", "n")
    low = F.col("anchor") - F.col("cell") * CELL - (CELL - 1)
    recurring = attach_by_key(
        cells.where("single and text is not null").select("context", "cell", "text", *TEXT, "anchor"),
        materialize(again, "again"),
        ["context", "cell", "text"],
    ).select(*TEXT, low.alias("low"), (low + (CELL - 1 + length)).alias("high"))
    # Cells with a core in common: every kind of known text gives one member, cells without one give all.
    mixed = (
        kinds.groupBy(*cell_key)
        .agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.count_if(F.col("text").isNull()).alias("open"))
        .where("kinds > 1 or (open > 0 and n > 1)")
        .select(*cell_key, "n")
    )
    mixed = materialize(mixed, "mixed")
    alone = (F.col("singles") > 0) & (F.col("n") == 1)  # of several, each is covered by the cell
    known = attach_by_key(
        kinds.where("text is not null").select(*cell_key, "member", alone.alias("single")), mixed, cell_key
    ).select("context", "cell", "member.*", "single")
    open_ = cells.where("text is null").select(*cell_key, *TEXT, "anchor", "single")
    open_ = attach_by_key(open_, mixed, cell_key).drop("core")
    strings = "context bigint, offset int, digest bigint, low int, single boolean"
    strings = _window_rows(docs, known.unionByName(open_), strings, _strings(length), "strings")
    string_key = ["context", "offset", "digest"]
    often = strings.groupBy(*string_key).agg(F.count(F.lit(1)).alias("n"), F.count_if("single").alias("singles"))
    often = materialize(often.where("n > 1 and singles > 0").select(*string_key, "n"), "often")
    found = attach_by_key(strings.where("single"), often, string_key)
    return recurring.unionByName(found.select(*TEXT, "low", (F.col("low") + length).alias("high")))


def _kept(texts, spans):
    """Bytes, removed bytes, removed runs and the digest of what stays, per text."""
    out = []
    for data, removed in zip(texts, spans.to_pylist()):
        view = memoryview(data.as_buffer())
        digest, at, gone, runs = hashlib.sha256(), 0, 0, 0
        for low, high in _joined(removed or []):
            low, high = max(0, low), min(len(view), high)
            digest.update(view[at:low])
            at, gone, runs = high, gone + high - low, runs + 1
        digest.update(view[at:])
        out.append((len(view), gone, runs, digest.hexdigest()))
    n, gone, runs, kept = zip(*out) if out else [()] * 4
    return None, [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())]


def _joined(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((x["low"], x["high"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def placed_texts(docs: DataFrame, doc_id: str, text: str, batches: int) -> Bucketed:
    """``TEXT``, doc_id, data, batch as a table bucketed by the input partition, which needs no shuffle."""
    named = with_number(docs.select(quoted(doc_id).alias("doc_id"), whole_bytes(text).alias("data")), "number")
    dealt = F.pmod(F.xxhash64("number"), F.lit(batches)).cast("int")
    rows = named.withColumn("part", F.spark_partition_id()).withColumn("batch", dealt)
    return Bucketed(rows, "texts", "part", split=["batch"])


def repeated_spans(texts: DataFrame, batches: int = BATCHES, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """``TEXT``, low, high: bytes covered by a string that starts elsewhere too."""
    spark = texts.sparkSession
    family, paths, entries = Family(), [], []
    for batch in range(batches):
        own = index_entries(texts.where(F.col("batch") == batch), length, window)
        paths.append(write_shared(own, "entries"))
        entries.append(spark.read.schema(own.schema).parquet(paths[-1]))
        family.add(entries[-1])
    contexts = materialize(family.contexts(), "contexts")
    places = materialize(attach_by_key(_all(entries), contexts, "context"), "places")
    family.drop()
    for path in paths:
        remove(spark, path)
    member = F.min(F.struct(*TEXT, "anchor", "first", "last")).alias("member")
    classes = materialize(places.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"), member), "classes")
    whole = materialize(classes.where("n > 1").select(*CLASS, "n"), "whole")
    covered = attach_by_key(places, whole, CLASS)
    covered = covered.select(*TEXT, F.col("first").alias("low"), (F.col("last") + length).alias("high"))
    return covered.unionByName(partial_matches(texts, classes, length))


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    window: int = WINDOW,
    batches: int = BATCHES,
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = placed_texts(docs, doc_id, text, batches)
    spans = repeated_spans(texts.rows, batches, length, window)
    per_text = spans.groupBy(*TEXT).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    per_text = materialize(per_text, "spans")
    both = texts.rows.join(per_text, TEXT, "left").select("doc_id", "data", "spans")
    report = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    rows = map_batches(both, ["doc_id"], [F.col("data"), F.col("spans")], report, lambda: _kept)
    with _beside_texts(docs.sparkSession):
        out = materialize(rows, "repeats")
    texts.drop()
    return out
