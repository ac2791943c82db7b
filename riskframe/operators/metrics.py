"""Tie-exact ranking and calibration metrics, overall or per group.

All ranking metrics come from one table of distinct scores with the positives
and negatives at each, so a score shared by a third of the rows is one row
after the partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from riskframe.operators.ordered import BUCKET, exact_quantiles, range_cuts, running_totals, with_ranges


def score_levels(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per (groups, distinct score): positives, negatives, range."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *groups, F.col(score).cast("double").alias("_score"), F.col(label).cast("int").alias("_label")
    )
    cuts = range_cuts(rows, ["_score"])
    placed = with_ranges(rows, cuts, {"_score": BUCKET})
    return placed.groupBy(*groups, BUCKET, "_score").agg(
        F.sum("_label").cast("bigint").alias("pos"), F.sum(1 - F.col("_label")).cast("bigint").alias("neg")
    )


def ranking_metrics(
    df: DataFrame, score: str, label: str, groups: Sequence[str] = (), stored: bool = False
) -> DataFrame:
    """n, actual_rate, mean_score, average_precision, roc_auc, brier per group.

    A group with one class only has no ROC-AUC; one without positives has no
    average precision. ``stored`` is for rows unfolded from others.
    """
    levels = score_levels(df, score, label, groups)
    steps = running_totals(levels, "_score", ["pos", "neg"], groups, descending=True, stored=stored)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    cum_pos, cum_neg = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    p = F.col("_score")
    sums = steps.groupBy(*groups).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(p * (pos + neg)).alias("score_sum"),
        F.sum(pos * cum_pos / (cum_pos + cum_neg)).alias("precision_sum"),
        F.sum(pos * cum_neg - F.lit(0.5) * pos * neg).alias("inversions"),
        F.sum(pos * (1 - p) * (1 - p) + neg * p * p).alias("square_sum"),
    )
    n = F.col("n_pos") + F.col("n_neg")
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return sums.select(
        *groups,
        n.alias("n"),
        (F.col("n_pos") / n).alias("actual_rate"),
        (F.col("score_sum") / n).alias("mean_score"),
        F.when(F.col("n_pos") > 0, F.col("precision_sum") / F.col("n_pos")).alias("average_precision"),
        F.when(pairs > 0, 1 - F.col("inversions") / pairs).alias("roc_auc"),
        (F.col("square_sum") / n).alias("brier"),
    )


def average_precision(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, label, groups).select(*groups, "average_precision")


def roc_auc(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, label, groups).select(*groups, "roc_auc")


def brier(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the probabilities: one partial aggregate."""
    gap = F.col(score).cast("double") - F.col(label).cast("double")
    return df.groupBy(*groups).agg(F.avg(gap * gap).alias("brier"))


def calibration_curve(df: DataFrame, scores: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Reliability table per score column over its quantile bins.

    A row's bin is the number of inner edges strictly below its score; bins no
    row falls in do not appear.
    """
    edges = exact_quantiles(df, scores, [i / bins for i in range(bins + 1)])
    cells = []
    for c in scores:
        p = F.col(c).cast("double")
        inner = [e for e in edges["all", c][1:-1] if e is not None]
        place = reduce(lambda a, e: a + (p > F.lit(e)).cast("int"), inner, F.lit(0))
        cells.append(F.struct(F.lit(c).alias("score_name"), p.alias("p"), place.alias("bin")))
    return (
        df.select(F.col(label).cast("double").alias("y"), F.explode(F.array(*cells)).alias("c"))
        .where(F.col("c.p").isNotNull())
        .groupBy("c.score_name", "c.bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("c.p").alias("mean_predicted"),
            F.avg("y").alias("observed_rate"),
        )
    )


def coverage_and_size(df: DataFrame, prediction_set: str, label: str) -> DataFrame:
    """Share of rows whose true label is in their set, and the mean set size."""
    inside = F.array_contains(prediction_set, F.col(label).cast(df.schema[prediction_set].dataType.elementType))
    return df.agg(
        F.avg(inside.cast("int")).alias("coverage"), F.avg(F.size(prediction_set)).alias("mean_size")
    )


def cv_summary(scores: DataFrame, metrics: Sequence[str] = ("average_precision", "roc_auc", "brier")) -> DataFrame:
    """Mean and population deviation of each metric over the folds."""
    return (
        scores.unpivot([], list(metrics), "metric", "value")
        .groupBy("metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    )
