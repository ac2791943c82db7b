"""Attaching per-key results to rows when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

#: Rows of one key that one task may receive.
SLICE_ROWS = 1_000_000
#: At most so many keys are sliced; beyond some 10^11 rows slices grow instead.
MOST_SLICED = 100_000


def attach_by_key(
    rows: DataFrame, keyed: DataFrame, key: str | Sequence[str], count: str = "n", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Inner join of rows to a table with one row per key and its row count.

    A key is cut into as many slices as its own count asks for: its row of
    ``keyed`` is repeated once per slice, and its rows are dealt over them. Only
    the keys of several slices are broadcast, with their slice number; there
    are at most ``MOST_SLICED`` by arithmetic. ``keyed`` should be a
    materialized table.
    """
    keys = [key] if isinstance(key, str) else list(key)
    other = [c for c in keyed.columns if c not in (*keys, count)]
    total = keyed.agg(F.sum(count)).first()[0] or 0
    size = max(slice_rows, total // MOST_SLICED + 1)
    sliced = keyed.withColumn("_slices", F.ceil(F.col(count) / size).cast("int"))
    several = sliced.where(F.col("_slices") > 1).select(*keys, "_slices")
    draw = F.xxhash64(F.monotonically_increasing_id())
    dealt = (
        _join(rows, F.broadcast(several), keys, "left")
        .withColumn("_slice", F.coalesce(F.pmod(draw, F.col("_slices")), F.lit(0)).cast("int"))
        .drop("_slices")
    )
    per_slice = F.explode(F.sequence(F.lit(0), F.greatest(F.col("_slices"), F.lit(1)) - 1))
    repeated = sliced.select(*keys, *other, per_slice.alias("_slice"))
    return _join(dealt, repeated, [*keys, "_slice"]).drop("_slice")


def _join(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where a missing key matches a missing key."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    renamed = keyed.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return rows.join(renamed, same, how).drop(*names.values())
