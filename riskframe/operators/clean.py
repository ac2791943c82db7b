"""Cleaning of raw records and removal of target leakage.

All steps are projections and filters: a whole clean is one narrow stage, and
the two filters on raw columns reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.expressions import as_col, grouped_code, text_columns, text_number, token_to_null


@dataclass(frozen=True)
class CleanRules:
    """Which columns and values the clean looks at."""

    token: str
    leak_column: str
    leak_values: Sequence[int]
    invalid_column: str
    invalid_value: str
    label_column: str
    positive_value: str
    target: str
    code_columns: Sequence[str]
    code_ranges: Sequence[tuple]
    code_other: str
    code_missing: str
    code_other_prefixes: Sequence[str] = ()
    dropped: Sequence[str] = ()


def replace_missing_token(df: DataFrame, token: str) -> DataFrame:
    """Turn the sentinel into NULL in every text column."""
    texts = set(text_columns(df))
    return df.select(*[token_to_null(c, token).alias(c) if c in texts else F.col(c) for c in df.columns])


def not_leaking(column: str | Column, values: Sequence) -> Column:
    """True unless the outcome code rules the target out; a missing code is kept."""
    c = as_col(column)
    return c.isNull() | ~c.isin(list(values))


def drop_leakage(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(not_leaking(column, values))


def drop_invalid(df: DataFrame, column: str, value: str) -> DataFrame:
    """Drop rows holding one invalid value; a missing value is kept."""
    return df.where(F.col(column).isNull() | (F.col(column) != value))


def add_binary_target(df: DataFrame, label: str, positive: str, target: str) -> DataFrame:
    """1 where the label is the positive class, else 0; the label goes."""
    return df.withColumn(target, F.col(label).eqNullSafe(positive).cast("byte")).drop(label)


def group_codes(
    df: DataFrame,
    columns: Sequence[str],
    ranges: Sequence[tuple],
    other: str,
    missing: str,
    other_prefixes: Sequence[str] = (),
    suffix: str = "_group",
) -> DataFrame:
    """Replace raw code columns by their group names.

    Each code is read as a number once, in a projection of its own, and not
    again in every branch of the grouping.
    """
    kept = [c for c in df.columns if c not in set(columns)]
    read = df.select("*", *[text_number(F.col(c).cast("string")).alias(f"_number_{c}") for c in columns])
    groups = [
        grouped_code(c, ranges, other, missing, other_prefixes, F.col(f"_number_{c}")).alias(c + suffix)
        for c in columns
    ]
    return read.select(*kept, *groups)


def clean(df: DataFrame, rules: CleanRules) -> DataFrame:
    """Sentinel, leakage, invalid rows, target, code groups, dropped columns.

    The row filters stand first because they look at values the sentinel step
    cannot change; stated on raw columns they are pushed into the scan.
    """
    return (
        df.transform(drop_leakage, rules.leak_column, rules.leak_values)
        .transform(drop_invalid, rules.invalid_column, rules.invalid_value)
        .transform(replace_missing_token, rules.token)
        .transform(add_binary_target, rules.label_column, rules.positive_value, rules.target)
        .transform(
            group_codes,
            rules.code_columns,
            rules.code_ranges,
            rules.code_other,
            rules.code_missing,
            rules.code_other_prefixes,
        )
        .drop(*rules.dropped)
    )


def clean_metrics(df: DataFrame, rules: CleanRules) -> DataFrame:
    """Rows in, rows out, rows lost to leakage, share of positives: one pass."""
    stays = not_leaking(rules.leak_column, rules.leak_values)
    valid = F.col(rules.invalid_column).isNull() | (F.col(rules.invalid_column) != rules.invalid_value)
    positive = F.col(rules.label_column).eqNullSafe(rules.positive_value).cast("int")
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(stays & valid).alias("rows_out"),
        F.count_if(~stays).alias("leakage_removed"),
        F.avg(F.when(stays & valid, positive)).alias("positive_rate"),
    )
