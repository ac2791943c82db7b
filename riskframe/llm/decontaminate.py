"""Benchmark decontamination: Wu-Manber search for benchmark windows in documents.

The symbols are words, so an occurrence always starts and ends at word bounds.
A table gives, for a block of two words, how far the search may jump; where it
may not, the block's bucket names the windows ending in it, and each is
compared word by word.

Defined cases: a missing or empty text has no words; an item without words has
no window; a missing item_id is a match like any other but names no item;
repeated rows and items change nothing; empty tables give unhit documents or
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import LOWER, UPPER, map_batches, quoted, whole_bytes
from riskframe.session import materialize

WINDOW = 10
#: Windows held in memory at once; more are searched for in further passes.
SHARD_WINDOWS = 400_000
RESULT = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"

_APART = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
_WORD_BYTES = bytes.maketrans(UPPER + _APART, LOWER + b" " * len(_APART))


def search_words(data: bytes) -> list[bytes]:
    """Runs of digits, letters a-z and all characters beyond ASCII; A-Z in lower case."""
    return data.translate(_WORD_BYTES).split()


class WuManber:
    """Search for many word sequences of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], int]):
        self.length = length
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ends: dict[tuple[bytes, ...], dict[tuple[bytes, ...], int]] = {}
        for words, number in patterns.items():
            for end in range(self.block, length + 1):
                block = words[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.jump), length - end)
            # The bucket compares whole sequences by their hash first.
            self.ends.setdefault(words[-self.block :], {})[words] = number

    def find(self, words: Sequence[bytes]) -> Iterator[tuple[int, int]]:
        """(first word, number of the pattern) of every occurrence."""
        shift, ends, size, jump, length = self.shift.get, self.ends, self.block, self.jump, self.length
        at, n = length, len(words)
        while at <= n:
            block = tuple(words[at - size : at])
            step = shift(block, jump)
            if step:
                at += step
                continue
            number = ends[block].get(tuple(words[at - length : at]))
            if number is not None:
                yield at - length, number
            at += 1


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """Distinct (item, words): every run of ``window`` words, or a shorter item whole."""

    def make():
        def step(texts):
            rows, out = [], []
            for i, data in enumerate(texts.to_pylist()):
                words = search_words(data)
                for first in range(max(1, len(words) - window + 1) if words else 0):
                    rows.append(i)
                    out.append(b" ".join(words[first : first + window]))
            return pa.array(rows, pa.int64()), [pa.array(out, pa.binary())]

        return step

    named = benchmark.select(quoted(item_id).cast("string").alias("item"), whole_bytes(text).alias("text"))
    return map_batches(named, ["item"], [F.col("text")], "words binary", make).distinct()


def _searchers(windows: Sequence[tuple[bytes, list[str]]]) -> tuple[list[WuManber], list[list[str]]]:
    by_length: dict[int, dict[tuple[bytes, ...], int]] = {}
    for number, (words, _) in enumerate(windows):
        sequence = tuple(bytes(words).split(b" "))
        by_length.setdefault(len(sequence), {})[sequence] = number
    return [WuManber(n, p) for n, p in sorted(by_length.items())], [items for _, items in windows]


def _merged(hits: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for first, last in sorted(hits):
        if out and first <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], last)
        else:
            out.append({"first": first, "last": last})
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def mark_occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_windows: int = SHARD_WINDOWS,
) -> DataFrame:
    """The kept columns, ``n_words``, ``spans`` (first and last word of each run of
    hit words) and ``items`` (ids of the items with an occurring window).

    Documents are mapped where they lie; nothing of them is shuffled. Windows
    are dealt over shards of bounded size, and each shard is one more pass that
    adds its hits to the rows.
    """
    # The windows are read once per shard, so they are written first.
    windows = materialize(benchmark_windows(benchmark, item_id, item_text, window), "windows")
    shards = max(1, -(-windows.count() // shard_windows))
    placed = windows.withColumn("shard", F.pmod(F.xxhash64("words", "item"), F.lit(shards)))
    rows = docs.select(
        *[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)],
        whole_bytes(text).alias("text"),
        F.lit(None).cast("array<struct<first:int,last:int>>").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    kept = [f"k{i}" for i in range(len(keep))]
    for shard in range(shards):
        # At most ``shard_windows`` rows, give or take the hash's spread.
        own = placed.where(F.col("shard") == shard).groupBy("words").agg(F.collect_set("item").alias("items")).collect()
        model = [(bytes(r["words"]), sorted(r["items"])) for r in own]
        last = shard == shards - 1
        rows = map_batches(
            rows,
            kept if last else [*kept, "text"],
            [F.col("text"), F.col("spans"), F.col("items")],
            RESULT,
            lambda model=model: _hits(model),
        )
        if not last:
            rows = materialize(rows.drop("n_words"), "searched")
    return rows.toDF(*keep, "n_words", "spans", "items")


def _hits(model: Sequence[tuple[bytes, list[str]]]):
    searchers, items_of = _searchers(model)

    def step(texts, spans, items):
        counts, found, named = [], [], []
        for data, old_spans, old_items in zip(texts.to_pylist(), spans.to_pylist(), items.to_pylist()):
            words = search_words(data)
            hits = [(s["first"], s["last"]) for s in old_spans or []]
            numbers = set()
            for searcher in searchers:
                for first, number in searcher.find(words):
                    hits.append((first, first + searcher.length - 1))
                    numbers.add(number)
            counts.append(len(words))
            found.append(_merged(hits))
            named.append(sorted({i for k in numbers for i in items_of[k]} | set(old_items or [])))
        return None, [pa.array(counts, pa.int64()), pa.array(found, _SPANS), pa.array(named, pa.list_(pa.string()))]

    return step


def hit_words(spans: Column) -> Column:
    """Number of words inside the spans, which don't overlap."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)


def occurrence_report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """Per document: words, hit words, items with occurring windows and their digest."""
    marked = mark_occurrences(docs, benchmark, keep=("doc_id",), **names)
    hit = hit_words(F.col("spans"))
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names) -> DataFrame:
    """The documents in which no window of the benchmark occurs, columns unchanged."""
    columns = docs.columns
    marked = mark_occurrences(docs, benchmark, keep=columns, text=text, **names)
    kept = [f"c{i}" for i in range(len(columns))]
    plain = marked.toDF(*kept, "n_words", "spans", "items")
    return plain.where(F.size("spans") == 0).select(*kept).toDF(*columns)
