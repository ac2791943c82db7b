"""Profiles of a table: size, groups, levels, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.expressions import float_columns, text_columns


def table_shape(df: DataFrame, group: str, approximate: bool = False) -> DataFrame:
    """Rows, columns, groups, mean rows per group, rows beyond a group's first."""
    distinct = F.approx_count_distinct(group) if approximate else F.count_distinct(group)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_groups")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        "n_groups",
        (F.col("n_rows") / F.col("n_groups")).alias("rows_per_group"),
        (F.col("n_rows") - F.col("n_groups")).alias("repeat_rows"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per level, the missing level included, largest first."""
    return (
        df.groupBy(F.col(column).alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("level"))
    )


def positive_rate(df: DataFrame, positive: Column) -> DataFrame:
    return df.agg(F.avg(F.coalesce(positive, F.lit(False)).cast("int")).alias("positive_rate"))


def missing_shares(df: DataFrame, token: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of missing cells per column, counted for all columns in one pass."""
    columns = list(columns or df.columns)
    texts, floats = set(text_columns(df)), set(float_columns(df))

    def absent(c: str) -> Column:
        out = F.col(c).isNull()
        if c in floats:
            out = out | F.isnan(c)
        if token is not None and c in texts:
            out = out | (F.col(c) == token)
        return out

    shares = df.agg(*[F.avg(F.when(absent(c), 1.0).otherwise(0.0)).alias(c) for c in columns])
    return shares.unpivot([], columns, "column_name", "missing_share")


def top_missing(df: DataFrame, token: str | None = None, n: int = 12) -> DataFrame:
    return (
        missing_shares(df, token)
        .where("missing_share > 0")
        .orderBy(F.desc("missing_share"), "column_name")
        .limit(n)
    )


# --- profiles that can be united ---------------------------------------------

#: Registers of a distinct-count sketch, as a power of two; its relative error is about 1.04 / sqrt(2 ** it).
SKETCH_BITS = 12


def delivery_profile(df: DataFrame, columns: Sequence[str], delivery: str, bits: int = SKETCH_BITS) -> DataFrame:
    """One delivery's stored profile: delivery, column_name, n_rows, n_missing, distinct (a sketch).

    Profiles of any deliveries are united by ``united_profile``; a new delivery is
    profiled alone and appended, the others are not read again.
    """
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in columns]
    return (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .select("c.*")
        .groupBy("column_name")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("level").isNull()).alias("n_missing"),
            F.hll_sketch_agg("level", F.lit(bits)).alias("distinct"),
        )
        .select(F.lit(delivery).alias("delivery"), "column_name", "n_rows", "n_missing", "distinct")
    )


def united_profile(profiles: DataFrame) -> DataFrame:
    """column_name, n_deliveries, n_rows, missing_share, n_distinct over the given deliveries."""
    return profiles.groupBy("column_name").agg(
        F.count_distinct("delivery").alias("n_deliveries"),
        F.sum("n_rows").alias("n_rows"),
        (F.sum("n_missing") / F.sum("n_rows")).alias("missing_share"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"),
    )
