"""Exact top-k inner products by a three-phase uniform threshold.

The components are split into lists; a list scores a vector by its own
components only, and the lists' scores add up to the whole score.

1. Every list gives its best vectors per query. Their whole scores, resolved
   exactly, give the query's cutoff: the k-th best score known so far.
2. The cutoff goes out to the lists. A vector that reaches it has, in at least
   one of m lists, a score of at least cutoff / m; lists return all such
   entries.
3. The entries' vectors are looked up, their scores resolved exactly, and those
   at the cutoff or above are ranked.

Equal vectors have equal scores, so each is kept once with its smallest ids, a
repeated row's id as often as it has rows.
Queries are taken in blocks of bounded size, each against all vectors.

Defined cases: vectors that are missing, empty, or hold a missing or non-finite
component take no part; shorter vectors count as ended by zeros; rows of the
query's own id are no candidates; ties go to the smaller id; of a query id with
several vectors the smallest one, by its components in order, is asked for; rows
without id take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.llm.common import quoted
from riskframe.session import materialize

LISTS = 2
#: Queries sent to all tasks at once: some MB.
BLOCK_QUERIES = 4_096
#: Cells (queries x vectors) of one score table in a task.
CELLS = 4_000_000


def whole_components(vectors: DataFrame, vec_id: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, x): floor(scale * component) of every vector that takes part."""
    v = quoted(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # The array is floored behind the filter, so no infinite value meets the cast.
    good = vectors.where(quoted(vec_id).isNotNull() & (F.size(v) > 0) & finite)
    x = F.transform(quoted(vector), lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    return good.select(quoted(vec_id).cast("bigint").alias("vec_id"), x.alias("x"))


def distinct_vectors(points: DataFrame, k: int) -> DataFrame:
    """(x, ids, vector): each vector once, with a number, to be written before it is read twice, and with the ids of its rows, as many as any query can need.

    Those are the k + 1 smallest different ids (one may be the query's own), each
    as often as it has rows with the vector, k times at most.
    """
    counted = points.groupBy("x", "vec_id").agg(F.count(F.lit(1)).alias("rows"))
    first = Window.partitionBy("x").orderBy("vec_id")
    # The limit on the row number is applied before the shuffle as well.
    return (
        counted.withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= k + 1)
        .select("x", F.explode(F.array_repeat("vec_id", F.least("rows", F.lit(k)).cast("int"))).alias("vec_id"))
        .groupBy("x")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumn("vector", F.monotonically_increasing_id())
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as one float64 table, zeros at the end of shorter ones."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: by floats while those are exact, else by integers."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if top < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _slices(width: int, lists: int) -> list[slice]:
    ends = [round(i * width / lists) for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def _scan(vectors: DataFrame, numbers: np.ndarray, queries: np.ndarray, lists: int, choose, schema: str) -> DataFrame:
    """Rows a task returns after it has scored its vectors, list by list."""
    width, parts = queries.shape[1], _slices(queries.shape[1], lists)
    height = max(1, CELLS // max(1, len(queries)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, height):
                part = batch.slice(at, height)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                rows = _matrix(part.column(1), width)
                for p in parts:
                    q, v = choose(_products(queries[:, p], rows[:, p]))
                    whole = np.einsum("ij,ij->i", queries[q].astype(np.int64), rows[v].astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers[q]), pa.array(ids[v]), pa.array(whole)], names=["query_id", "vector", "score"]
                    )

    return vectors.select("vector", "x").mapInArrow(run, schema)


_SCORED = "query_id bigint, vector bigint, score bigint"


def _local_best(k: int):
    def choose(scores: np.ndarray):
        take = min(k, scores.shape[1])
        best = np.argpartition(scores, scores.shape[1] - take, axis=1)[:, -take:] if take else scores.astype(int)
        return np.repeat(np.arange(len(scores)), take), best.ravel()

    return choose


def _at_least(cutoffs: np.ndarray, lists: int):
    def choose(scores: np.ndarray):
        return np.nonzero(scores * lists >= cutoffs[:, None])

    return choose


def _block_top(
    vectors: DataFrame, numbers: np.ndarray, queries: np.ndarray, k: int, lists: int, own: int
) -> DataFrame:
    """The k best rows of each query of one block; no query id has more than ``own`` vectors."""
    need = k + own  # the query's own vectors may count for nothing
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vector")
    local = _scan(vectors, numbers, queries, lists, _local_best(need), _SCORED).distinct()
    known = local.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= need)
    lows = known.groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n")).collect()
    # One row per query of the block; with fewer vectors than needed, everything is returned.
    everything = -(2**62) // max(1, lists)
    cutoff = {r["query_id"]: r["cutoff"] if r["n"] >= need else everything for r in lows}
    cutoffs = np.array([cutoff.get(int(n), everything) for n in numbers], dtype=np.int64)
    entries = _scan(vectors, numbers, queries, lists, _at_least(cutoffs, lists), _SCORED)
    spark = vectors.sparkSession
    asked = spark.createDataFrame([(int(n), int(c)) for n, c in zip(numbers, cutoffs)], "query_id bigint, cutoff bigint")
    enough = (
        entries.join(F.broadcast(asked), "query_id")  # one row per query of the block
        .where(F.col("score") >= F.col("cutoff"))
        .select("query_id", "vector", "score")
        .distinct()
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        enough.join(vectors.select("vector", "ids"), "vector")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def top_inner_products(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    lists: int = LISTS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Per query its k best other rows: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    points = materialize(whole_components(vectors, vec_id, vector), "components")
    distinct = materialize(distinct_vectors(points, k), "vectors")
    asked = points.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x"), F.count_distinct("x").alias("own"))
    n, width = points.agg(F.count_if(is_query), F.max(F.size("x"))).first()  # repeats only make more blocks
    blocks = max(1, -(-n // block_queries))
    placed = materialize(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "queries")
    most_own = placed.agg(F.max("own")).first()[0]
    found = []
    for block in range(blocks if n else 0):
        own = placed.where(F.col("block") == block).select("vec_id", "x").toArrow()  # a block's queries
        if own.num_rows:
            own = own.combine_chunks().to_batches()[0]
            queries = _matrix(own.column(1), width)
            top = _block_top(distinct, own.column(0).to_numpy(zero_copy_only=False), queries, k, lists, most_own)
            found.append(materialize(top, "top") if blocks > 1 else top)
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
