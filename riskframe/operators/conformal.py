"""Split-conformal prediction sets for a binary target."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.operators.ordered import values_at_ranks

LEVEL = 0.9


def nonconformity(prob: Column, label: Column) -> Column:
    """1 - probability given to the class ``label`` (0 or 1)."""
    return 1 - F.when(label == 1, prob).otherwise(1 - prob)


def threshold_rank(n: int, level: float) -> int:
    """1-based place of the threshold among n sorted scores."""
    return min(n, math.ceil((n + 1) * level - 1e-12))


def conformal_threshold(df: DataFrame, prob: str, label: str, level: float = LEVEL) -> tuple[int, int, float]:
    """(rows, rank, threshold) from the conform split."""
    scored = df.select(nonconformity(F.col(prob).cast("double"), F.col(label)).alias("score"))
    found, counts, _ = values_at_ranks(scored, ["score"], lambda _s, _c, n: [threshold_rank(n, level) - 1])
    n = counts["all", "score"]
    if n == 0:
        raise ValueError("the conform split is empty")
    rank = threshold_rank(n, level)
    return n, rank, found["all", "score"][rank - 1]


def prediction_set(prob: Column, threshold: float, labels: Sequence) -> Column:
    """Labels whose nonconformity is within the threshold: none, one or both."""
    inside = [
        F.when(nonconformity(prob, F.lit(i)) <= F.lit(threshold), F.lit(name)) for i, name in enumerate(labels)
    ]
    return F.array_compact(F.array(*inside))


def with_prediction_set(
    df: DataFrame, prob: str, threshold: float, labels: Sequence = (0, 1), out: str = "prediction_set"
) -> DataFrame:
    return df.withColumn(out, prediction_set(F.col(prob).cast("double"), threshold, labels))
