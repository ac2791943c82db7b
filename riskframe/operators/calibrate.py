"""Probability calibration of a fixed model's scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from riskframe.session import materialize

METHODS = ("isotonic", "sigmoid")


@dataclass(frozen=True)
class Calibration:
    """How a raw score becomes a probability."""

    method: str
    slope: float | None = None
    offset: float | None = None
    curve: IsotonicRegressionModel | None = None

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        if self.method == "sigmoid":
            margin = F.lit(self.slope) * F.col(score) + F.lit(self.offset)
            return df.withColumn(out, 1 / (1 + F.exp(margin)))
        curve = self.curve.copy({self.curve.featuresCol: "_raw", self.curve.predictionCol: out})
        return curve.transform(df.withColumn("_raw", F.col(score).cast("double"))).drop("_raw")


def fit_isotonic(df: DataFrame, score: str, label: str) -> Calibration:
    """Monotone curve; equal scores are pooled before the fit."""
    pooled = (
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.avg(F.col(label).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    )
    fit = IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight", predictionCol="prediction")
    return Calibration("isotonic", curve=fit.fit(pooled))


def fit_sigmoid(df: DataFrame, score: str, label: str) -> Calibration:
    """Two-parameter logistic curve on smoothed targets.

    A row with target t stands as a positive of weight t and a negative of
    weight 1 - t, which makes it an unpenalised weighted logistic regression.
    Rows of one score are pooled, so it iterates over the distinct scores.
    """
    y = F.col(label).cast("double")
    pooled = materialize(
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.sum(F.when(y > 0, 1.0).otherwise(0.0)).alias("pos"), F.count(y).cast("double").alias("n")),
        "pooled",
    )
    n_pos, n = (v or 0.0 for v in pooled.agg(F.sum("pos"), F.sum("n")).first())
    high, low = (n_pos + 1) / (n_pos + 2), 1 / (n - n_pos + 2)
    target = F.col("pos") * high + (F.col("n") - F.col("pos")) * low
    halves = F.array(
        F.struct(F.lit(1.0).alias("label"), target.alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") - target).alias("weight")),
    )
    doubled = pooled.select("score", F.explode(halves).alias("h")).select("score", "h.*")
    model = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", regParam=0.0, maxIter=200, tol=1e-10
    ).fit(VectorAssembler(inputCols=["score"], outputCol="features").transform(doubled))
    return Calibration("sigmoid", slope=-float(model.coefficients[0]), offset=-float(model.intercept))


def fit_calibration(df: DataFrame, score: str, label: str, method: str) -> Calibration:
    return {"isotonic": fit_isotonic, "sigmoid": fit_sigmoid}[method](df, score, label)


def brier_by_method(df: DataFrame, label: str, columns: dict[str, str]) -> DataFrame:
    """Brier score of several probability columns: method, brier."""
    y = F.col(label).cast("double")
    scores = df.agg(*[F.avg((F.col(c) - y) * (F.col(c) - y)).alias(m) for m, c in columns.items()])
    return scores.unpivot([], list(columns), "method", "brier")


def select_method(briers: DataFrame) -> DataFrame:
    """The method with the lowest Brier score (ties by name)."""
    return briers.orderBy("brier", "method").limit(1)

