"""Subgroup audit of a score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskframe.operators.metrics import ranking_metrics

MIN_GROUP_ROWS = 200


def subgroup_rows(df: DataFrame, attributes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows once per attribute, without those whose attribute is missing."""
    cells = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("subgroup")) for a in attributes]
    return (
        df.select(*keep, F.explode(F.array(*cells)).alias("cell"))
        .select(*keep, "cell.*")
        .where(F.col("subgroup").isNotNull())
    )


def subgroup_metrics(
    df: DataFrame, target: str, prob: str, attributes: Sequence[str], digits: int | None = 3
) -> DataFrame:
    """attribute, subgroup, n, actual_rate, mean_risk, roc_auc.

    ROC-AUC is NULL in a subgroup with one class. A subgroup of any size is
    spread over score ranges, so no task holds one subgroup.
    """
    long = subgroup_rows(df, attributes, [target, prob])
    out = ranking_metrics(long, prob, target, ["attribute", "subgroup"], stored=True)

    def shown(c: str):
        return F.col(c) if digits is None else F.round(c, digits)

    return out.select(
        "attribute",
        "subgroup",
        "n",
        shown("actual_rate").alias("actual_rate"),
        shown("mean_score").alias("mean_risk"),
        shown("roc_auc").alias("roc_auc"),
    )


def subgroup_gap(metrics: DataFrame, min_rows: int = MIN_GROUP_ROWS) -> DataFrame:
    """Largest minus smallest ROC-AUC per attribute over the larger subgroups."""
    return (
        metrics.where((F.col("n") >= min_rows) & F.col("roc_auc").isNotNull())
        .groupBy("attribute")
        .agg(F.count(F.lit(1)).alias("n_groups"), (F.max("roc_auc") - F.min("roc_auc")).alias("auc_gap"))
        .where("n_groups >= 2")
    )
