"""Scoring of batches and streams with a saved bundle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.operators.attrib import Explainer, with_reasons
from riskframe.operators.calibrate import Calibration
from riskframe.operators.conformal import prediction_set
from riskframe.operators.model import FittedModel
from riskframe.operators.prep import FeatureSpec

# Names of the two classes in scored records.
LABELS = ("non_readmis", "readmission_30j")
CUTOFF = 0.5


@dataclass(frozen=True)
class Bundle:
    """Everything scoring needs."""

    model: FittedModel
    calibration: Calibration
    threshold: float
    level: float
    explain: Explainer
    labels: Sequence[str] = LABELS


def partial_rows(df: DataFrame, features: str, spec: FeatureSpec) -> DataFrame:
    """Full feature columns from a map of the known ones; absent ones are NULL."""
    kept = [c for c in df.columns if c != features]
    known = F.col(features)
    return df.select(
        *kept,
        *[F.try_element_at(known, F.lit(c)).try_cast("double").alias(c) for c in spec.numeric],
        *[F.try_element_at(known, F.lit(c)).cast("string").alias(c) for c in spec.categorical],
    )


def with_feature_columns(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Add expected columns a table lacks, as missing."""
    absent = [c for c in spec.columns if c not in df.columns]
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in absent])


def risk_label(prob: Column, labels: Sequence[str] = LABELS, cutoff: float = CUTOFF) -> Column:
    return F.when(prob >= cutoff, labels[1]).otherwise(labels[0])


def score_batch(df: DataFrame, bundle: Bundle, keep: Sequence[str] | None = None) -> DataFrame:
    """Score records: risk, label, prediction set, level, method, reasons.

    One narrow stage on a stream; on a table, reasons are found once for rows the
    model cannot tell apart. Reasons explain the model's score before calibration.
    """
    keep = list(keep if keep is not None else df.columns)
    scored = bundle.model.stages.transform(with_feature_columns(df, bundle.model.spec)).select(
        *keep, "features", vector_to_array("probability")[1].alias("_p")
    )
    scored = with_reasons(bundle.calibration.apply(scored, "_p", "_risk"), bundle.explain, "_reasons")
    risk = F.col("_risk")
    return scored.select(
        *keep,
        F.round(risk, 4).alias("risk"),
        risk_label(risk, bundle.labels).alias("risk_label"),
        prediction_set(risk, bundle.threshold, bundle.labels).alias("prediction_set"),
        F.lit(bundle.level).alias("confidence_level"),
        F.lit(bundle.calibration.method).alias("calibration_method"),
        F.col("_reasons").alias("top_reasons"),
    )
