"""Scalar building blocks: missing values, code groups, repeatable draws."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Text accepted as a number. The cast alone would also take '250d' or '0x1p3'.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

DRAW_RANGE = 1 << 32


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def token_to_null(c: str | Column, token: str) -> Column:
    """NULL where the whole cell equals ``token``."""
    return F.nullif(as_col(c), F.lit(token))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Give floating columns one kind of missing value."""
    floats = set(float_columns(df))
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def text_number(c: str | Column) -> Column:
    """The number written in a text cell, NULL where it is not one."""
    c = as_col(c)
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def grouped_code(
    c: str | Column,
    ranges: Sequence[tuple],
    other: str,
    missing: str,
    other_prefixes: Sequence[str] = (),
    number: Column | None = None,
) -> Column:
    """Name of the first range a code falls in.

    ``ranges`` holds ``(name, low, high, high_included, single_value)``; a code
    that starts with one of ``other_prefixes``, is no number, or is in no range
    is ``other``, a NULL is ``missing``. ``number`` is the code's number where a
    projection before has read it.
    """
    c = as_col(c).cast("string")
    number = text_number(c) if number is None else number

    def hit(rule: tuple) -> Column:
        _, low, high, included, single = rule
        inside = (number >= low) & ((number <= high) if included else (number < high))
        return inside if single is None else inside | (number == single)

    branches = [(c.isNull(), missing)]
    if other_prefixes:
        branches.append((reduce(lambda a, b: a | b, [c.startswith(p) for p in other_prefixes]), other))
    branches += [(hit(rule), rule[0]) for rule in ranges]
    first, *rest = branches
    return reduce(lambda acc, b: acc.when(b[0], F.lit(b[1])), rest, F.when(first[0], F.lit(first[1]))).otherwise(
        F.lit(other)
    )


def key_digest(seed: int | str, *keys: str | Column) -> Column:
    """md5 of the seed and a row's key: the same order for any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_col(k).cast("string") for k in keys]))


def digest_number(digest: Column) -> Column:
    """First 8 hex digits of a digest as an integer in [0, 2**32)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def draw_int(seed: int | str, n: int, *keys: str | Column) -> Column:
    """A repeatable integer in [0, n) for each key."""
    return F.pmod(digest_number(key_digest(seed, *keys)), F.lit(n)).cast("int")


def draw_unit(seed: int | str, *keys: str | Column) -> Column:
    """A repeatable number in [0, 1) for each key."""
    return digest_number(key_digest(seed, *keys)) / F.lit(float(DRAW_RANGE))


def next_level(c: str | Column, levels: Sequence[str], steps: int = 1) -> Column:
    """The level ``steps`` further in an ordered list, stopping at the last."""
    c = as_col(c)
    ordered = F.array(*[F.lit(v) for v in levels])
    place = F.array_position(ordered, c)
    moved = F.element_at(ordered, F.least(place + steps, F.lit(len(levels))).cast("int"))
    return F.when(place > 0, moved).otherwise(c)


def clipped(c: Column, low=None, high=None) -> Column:
    """``c`` held within bounds; NULL stays NULL."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def percent_text(c: Column) -> Column:
    return F.format_string("%.0f%%", c * 100)
