"""Sharding by longest-processing-time scheduling.

Rows of equal text stay together. Groups, largest first, go through a heap to
the shard with the least bytes so far. A group above a fixed share of all bytes
is scheduled alone; the others are first put together by hash into bundles,
which are scheduled like groups. So the heap's work has one bound at any size
of the table, and no bundle is large enough to disturb the balance.

Defined cases: a missing text has no bytes and the group of the empty text;
repeated rows and missing ids are rows like any other; an empty table gives no
rows.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import quoted, slots, whole_bytes, with_number
from riskframe.session import materialize

SHARDS = 8
#: Groups of more than 1/GRAIN of all bytes are scheduled alone, so at most GRAIN are.
GRAIN = 40_000
BUNDLES = 16_384
#: Rows numbered in one task.
PART_ROWS = 50_000


def longest_first(sizes: list[tuple[int, str]], shards: int) -> list[int]:
    """Shard of each (size, key): by falling size, then key, to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], sizes[i][1])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + sizes[i][0], shard))
        out[i] = shard
    return out


def shard_by_size(
    docs: DataFrame,
    shards: int = SHARDS,
    doc_id: str = "doc_id",
    text: str = "text",
    grain: int = GRAIN,
    bundles: int = BUNDLES,
) -> DataFrame:
    """Per row: doc_id, size (bytes plus 1), text_crc32, shard, slot (gapless from 0 in its shard)."""
    spark = docs.sparkSession
    data = whole_bytes(text)
    rows = docs.select(
        quoted(doc_id).alias("doc_id"),
        (F.octet_length(data) + 1).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.unhex(F.sha2(data, 256)).alias("same"),  # equal texts
    )
    rows = materialize(with_number(rows, "number"), "sized")
    groups = rows.groupBy("same").agg(F.sum("size").alias("bytes"))
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    limit = (total or 0) // grain
    bundle = F.pmod(F.xxhash64("same"), F.lit(bundles))
    # A group's key is its own digest if it is large, else its bundle's number.
    item = F.when(F.col("bytes") > limit, F.hex("same")).otherwise(bundle.cast("string"))
    items = groups.groupBy(item.alias("item")).agg(F.sum("bytes").alias("bytes"))
    listed = [(int(r["bytes"]), r["item"]) for r in items.collect()]  # at most grain + bundles rows
    placed = spark.createDataFrame(
        [(key, s) for (_, key), s in zip(listed, longest_first(listed, shards))], "item string, shard int"
    )
    own = F.broadcast(placed.withColumnRenamed("shard", "own"))  # at most grain + bundles rows
    rest = F.broadcast(placed.withColumnRenamed("shard", "rest").withColumnRenamed("item", "bundle"))
    dealt = (
        rows.join(own, F.hex("same") == F.col("item"), "left")
        .join(rest, bundle.cast("string") == F.col("bundle"), "left")
        .withColumn("shard", F.coalesce("own", "rest"))
    )
    parts = max(256, math.ceil(n / (shards * PART_ROWS)))
    numbered = slots(dealt.drop("own", "rest", "item", "bundle", "same"), "shard", "number", "slot", ["doc_id"], parts)
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    out = shard_by_size(docs, shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
