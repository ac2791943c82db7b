"""Scoring, contract checks and drift on streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from riskframe.operators.contract import Contract, absent_findings, split_by_contract
from riskframe.operators.drift import DISTANCE_LIMIT, MIN_STD
from riskframe.operators.score import Bundle, score_batch


def score_stream(stream: DataFrame, bundle: Bundle, keep: Sequence[str] | None = None) -> DataFrame:
    """The batch scoring applied to a stream: stateless."""
    return score_batch(stream, bundle, keep)


def event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Give a zone-less time column a watermark."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def unique_keys(stream: DataFrame, key: str) -> DataFrame:
    """Drop repeats of a key that arrive within the watermark."""
    return stream.dropDuplicatesWithinWatermark([key])


def write_checked(
    contract: Contract, good_path: str, quarantine_path: str
) -> Callable[[DataFrame, int], None]:
    """Batch writer: rows that keep the contract go on, findings are set aside.

    Each batch owns a folder, so a batch that is run again replaces its rows.
    Declared columns that the stream lacks are findings of its first batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read once for both writes
        try:
            good, findings = split_by_contract(batch, contract)
            if batch_id == 0:
                findings = findings.unionByName(absent_findings(batch, contract))
            good.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
            findings.write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def check_stream(
    stream: DataFrame, contract: Contract, good_path: str, quarantine_path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write_checked(contract, good_path, quarantine_path))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def window_counts(stream: DataFrame, time: str, columns: Sequence[str], width: str) -> DataFrame:
    """Rows per tumbling window, column and level."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in columns]
    return (
        stream.select(time, F.explode(F.array(*cells)).alias("cell"))
        .groupBy(F.window(time, width).alias("w"), "cell.column_name", "cell.level")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "column_name", "level", "n")
    )


def reference_shares(reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, level, share of a static reference table."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in columns]
    counts = (
        reference.select(F.explode(F.array(*cells)).alias("cell"))
        .groupBy("cell.column_name", "cell.level")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("level").isNotNull())
    )
    sizes = counts.groupBy("column_name").agg(F.sum("n").alias("rows"))
    return counts.join(F.broadcast(sizes), "column_name").select(  # one row per compared column
        "column_name", "level", (F.col("n") / F.col("rows")).alias("share")
    )


def window_drift(counts: DataFrame, shares: DataFrame, limit: float = DISTANCE_LIMIT) -> DataFrame:
    """Jensen-Shannon distance of each window from the reference shares.

    Levels the window lacks count through the share it leaves over: the sum
    over shared levels, plus ln 2 per unmatched share on either side.
    """
    counts = counts.where(F.col("level").isNotNull())
    at = ["window_start", "column_name"]
    sizes = counts.groupBy(*at).agg(F.sum("n").alias("rows"))
    seen = counts.join(sizes, at).join(shares, ["column_name", "level"], "left")
    q = F.col("n") / F.col("rows")
    p = F.coalesce("share", F.lit(0.0))
    mid = (p + q) / 2
    terms = F.when(p > 0, p * F.log(p / mid)).otherwise(0.0) + q * F.log(q / mid)
    distance = F.sqrt(F.greatest(F.col("seen") + (1 - F.col("matched")) * math.log(2), F.lit(0.0)) / 2)
    return (
        seen.groupBy(*at)
        .agg(F.max("rows").alias("rows"), F.sum(terms).alias("seen"), F.sum(p).alias("matched"))
        .select(*at, "rows", distance.alias("js_distance"))
        .withColumn("drifted", F.col("js_distance") >= limit)
    )


# --- windows that close ------------------------------------------------------


def write_closed(out_path: str, finish: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """Batch writer for append mode: every closed window has a folder of its own, written once.

    A batch that is run again replaces the folders of its windows and no others.
    ``finish`` turns closed aggregates into the rows to keep.
    """

    def write(closed: DataFrame, batch_id: int) -> None:
        rows = finish(closed) if finish else closed
        named = rows.withColumn("window", F.date_format("window_start", "yyyyMMddHHmmss"))
        one_task = named.repartition("window")  # a window's few rows make one file
        one_task.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window").parquet(out_path)

    return write


def run_closed(windows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream whose windows are written when the watermark passes their end, and then forgotten."""
    writer = windows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def late_rows(query: StreamingQuery) -> int:
    """Aggregated rows that came after their window had closed, over the query's known batches."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def open_rows(query: StreamingQuery) -> list[int]:
    """Rows of state after each batch."""
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]


# --- numeric columns by quantile sketches ------------------------------------

#: Sketch size, and points at which two sketches are compared.
SKETCH_K, GRID = 1024, 256


def rank_error(k: int = SKETCH_K) -> float:
    """The sketch's published rank error (99 % of queries)."""
    return 2.296 / k**0.9723


def _sketched(values: DataFrame, *by, k: int = SKETCH_K) -> DataFrame:
    return values.groupBy(*by).agg(
        F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"),
        F.count("value").alias("rows"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.stddev_pop("value").alias("std"),
    )


def _long_numbers(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).try_cast("double").alias("value")) for c in columns]
    rows = df.select(*keep, F.explode(F.array(*cells)).alias("cell")).select(*keep, "cell.*")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def reference_sketches(reference: DataFrame, columns: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """column_name, sketch, rows, low, high, std of a static table; it can be stored and merged."""
    return _sketched(_long_numbers(reference, columns), "column_name", k=k)


def window_sketches(stream: DataFrame, time: str, columns: Sequence[str], width: str, k: int = SKETCH_K) -> DataFrame:
    """A sketch per tumbling window and numeric column."""
    window = F.window(time, width).alias("w")
    out = _sketched(_long_numbers(stream, columns, time), window, "column_name", k=k)
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])


def merge_windows(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of stored windows united, for any range of windows."""
    return sketches.groupBy(*by, "column_name").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"),
        F.sum("rows").alias("rows"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def sketch_drift(windows: DataFrame, reference: DataFrame, limit: float = DISTANCE_LIMIT, k: int = SKETCH_K) -> DataFrame:
    """window_start, column_name, rows, ks, wasserstein, the most either may be off, drifted.

    A sketch's quantiles at equal steps stand for its distribution function: at
    any point it is off by a step and the rank error at most. Wasserstein
    distance is in reference deviations, as is its bound.
    """
    known = reference.select(*[F.col(c).alias("column_name" if c == "column_name" else f"ref_{c}") for c in reference.columns])
    both = windows.join(F.broadcast(known), "column_name")  # one row per compared column
    grid = F.array(*[F.lit(i / GRID) for i in range(1, GRID + 1)])
    both = both.withColumn("q", F.kll_sketch_get_quantile_double("sketch", grid))
    both = both.withColumn("ref_q", F.kll_sketch_get_quantile_double("ref_sketch", grid))
    both = both.withColumn("x", F.array_sort(F.array_distinct(F.concat("q", "ref_q", F.array("low", "ref_low")))))

    def below(quantiles: str, x):
        return F.size(F.filter(quantiles, lambda v: v <= x))

    both = both.withColumn("gap", F.transform("x", lambda x: F.abs(below("q", x) - below("ref_q", x)) / GRID))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("x") - 1, F.lit(1))), lambda i: (
        F.element_at("gap", i) * (F.coalesce(F.try_element_at("x", i + 1), F.element_at("x", i)) - F.element_at("x", i))
    ))
    scale = F.greatest(F.coalesce("ref_std", F.lit(0.0)), F.lit(MIN_STD))
    most = 2 * (rank_error(k) + 1 / GRID)
    distance = F.aggregate(steps, F.lit(0.0), lambda t, v: t + v) / scale
    return both.select(
        "window_start",
        "column_name",
        "rows",
        F.array_max("gap").alias("ks"),
        F.lit(most).alias("ks_bound"),
        distance.alias("wasserstein"),
        (F.lit(most) * (F.greatest("high", "ref_high") - F.least("low", "ref_low")) / scale).alias("wasserstein_bound"),
        (distance >= limit).alias("drifted"),
    )


# --- complete results --------------------------------------------------------


def write_window_drift(shares: DataFrame, out_path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer for complete-mode counts: replaces the drift table."""

    def write(counts: DataFrame, batch_id: int) -> None:
        window_drift(counts, shares).write.mode("overwrite").parquet(out_path)

    return write


def replace_table(out_path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    return write


def run_complete(counts: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a windowed stream over what is available, writing complete results."""
    query = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
