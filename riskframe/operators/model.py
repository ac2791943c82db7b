"""Classifiers, class weights, grouped cross-validation and search."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.operators import boost, search
from riskframe.operators.boost import TUNED_BOOST
from riskframe.operators.metrics import cv_summary, ranking_metrics
from riskframe.operators.prep import FeatureSpec, PrepStats, encoder, feature_names, fit_stats, training_sets
from riskframe.operators.split import SEED, with_folds
from riskframe.session import materialize, together

# A learner fits on (features, label) rows.
Learner = Callable[[DataFrame], Model]

# Search space as (kind, low, high).
SEARCH_SPACE = {
    "n_estimators": ("int", 200, 600),
    "learning_rate": ("log", 0.01, 0.2),
    "num_leaves": ("int", 15, 127),
    "max_depth": ("int", 3, 12),
    "min_child_samples": ("int", 10, 200),
    "subsample": ("real", 0.6, 1.0),
    "colsample_bytree": ("real", 0.6, 1.0),
    "reg_alpha": ("log", 1e-3, 10.0),
    "reg_lambda": ("log", 1e-3, 10.0),
}
TRIALS = 25
TUNING_FOLDS = 3


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, balanced (n / 2n_c) and positive_ratio (n0/n1 for positives)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    both = Window.partitionBy(F.lit(0))  # one row per class
    n_of = {c: F.sum(F.when(F.col("label") == c, F.col("n"))).over(both) for c in (0, 1)}
    return counts.select(
        "label",
        "n",
        (F.sum("n").over(both) / (F.count(F.lit(1)).over(both) * F.col("n"))).alias("balanced"),
        F.when(F.col("label") == 1, n_of[0] / n_of[1]).otherwise(1.0).alias("positive_ratio"),
    )


def _class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    if not row[0] or not row[1]:
        raise ValueError("training rows hold one class only")
    return row[0], row[1]


def logistic_learner(max_iter: int = 1000, strength: float = 1.0) -> Learner:
    """Balanced logistic regression with an L2 penalty of ``1 / strength``.

    The balanced weights add up to the number of rows and the loss is divided
    by them, so the penalty per row is 1 / (strength * n).
    """

    def fit(rows: DataFrame) -> Model:
        n0, n1 = _class_counts(rows, "label")
        n = n0 + n1
        weight = F.when(F.col("label") == 1, n / (2 * n1)).otherwise(n / (2 * n0))
        return LogisticRegression(
            featuresCol="features",
            labelCol="label",
            weightCol="weight",
            regParam=1 / (strength * n),
            standardization=False,
            maxIter=max_iter,
            tol=1e-8,
        ).fit(rows.withColumn("weight", weight))

    return fit


def boosted_learner(params: Mapping | None = None, positive_weight: float | None = None, seed: int = SEED) -> Learner:
    """Leaf-wise boosted trees with positives weighted by n0/n1; without ``params`` the booster's own defaults."""

    def fit(rows: DataFrame) -> Model:
        ratio = positive_weight
        if ratio is None:
            n0, n1 = _class_counts(rows, "label")
            ratio = n0 / n1
        return boost.train(rows, boost.BoostParams(**(params or {})), float(ratio), seed)

    return fit


@dataclass(frozen=True)
class FittedModel:
    """Encoder and classifier with the names of the vector's entries."""

    spec: FeatureSpec
    names: list[str]
    stages: PipelineModel

    @property
    def classifier(self) -> Model:
        return self.stages.stages[-1]

    @property
    def encoder(self) -> PipelineModel:
        return PipelineModel(self.stages.stages[:-1])


def training_rows(df: DataFrame, target: str, prep: PipelineModel) -> DataFrame:
    return prep.transform(df).select("features", F.col(target).cast("double").alias("label"))


def fit_model(
    df: DataFrame, spec: FeatureSpec, target: str, learner: Learner, stats: PrepStats | None = None
) -> FittedModel:
    stats = stats or fit_stats(df, spec)["all"]
    prep = encoder(df.sparkSession, spec, stats)
    model = learner(training_rows(df, target, prep))
    return FittedModel(spec, feature_names(spec, stats), PipelineModel([*prep.stages, model]))


def score(df: DataFrame, model: FittedModel, out: str = "p") -> DataFrame:
    """The table with P(y=1)."""
    scored = model.stages.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


@dataclass(frozen=True)
class FoldedTable:
    """A fold-tagged table with each fold's training statistics."""

    table: DataFrame
    spec: FeatureSpec
    target: str
    k: int
    stats: dict[str, PrepStats]


def folded_table(
    df: DataFrame, spec: FeatureSpec, target: str, group: str, k: int = 5, seed: int = SEED
) -> FoldedTable:
    """Tag folds once, keep only the needed columns, gather all folds' statistics
    in the same passes; every model of a search starts from here."""
    slim = df.select(*dict.fromkeys([group, target, *spec.columns]))
    table = materialize(with_folds(slim, group, target, k, seed), "folded")
    return FoldedTable(table, spec, target, k, fit_stats(table, spec, training_sets("fold", k)))


def out_of_fold_scores(folded: FoldedTable, learner: Learner) -> DataFrame:
    """fold, label, p: each row scored by the model that did not see its fold.

    The folds' models are fitted side by side over the one written table.
    """

    def scored(i: int) -> DataFrame:
        train = folded.table.where(F.col("fold") != i)
        model = fit_model(train, folded.spec, folded.target, learner, folded.stats[str(i)])
        return score(folded.table.where(F.col("fold") == i), model).select(
            "fold", F.col(folded.target).cast("int").alias("label"), "p"
        )

    parts = together(folded.table.sparkSession, [partial(scored, i) for i in range(folded.k)])
    return materialize(reduce(DataFrame.unionByName, parts), "oof")


def grouped_cv_scores(folded: FoldedTable, learner: Learner) -> DataFrame:
    """fold, average_precision, roc_auc, brier."""
    return ranking_metrics(out_of_fold_scores(folded, learner), "p", "label", ["fold"]).select(
        "fold", "average_precision", "roc_auc", "brier"
    )


@dataclass(frozen=True)
class SearchResult:
    best_params: dict
    best_value: float
    trials: list[tuple[dict, float]]


def tune(
    df: DataFrame,
    spec: FeatureSpec,
    target: str,
    group: str,
    n_trials: int = TRIALS,
    folds: int = TUNING_FOLDS,
    seed: int = SEED,
    space: Mapping[str, tuple] = SEARCH_SPACE,
    positive_weight: float | None = None,
    log: str | None = None,
    study: str = "tuning",
    at_once: int = 1,
) -> SearchResult:
    """Search by Parzen estimators for the best mean out-of-fold average precision.

    ``log`` names a run log: finished trials of the study are read from it and
    not run again, so a search that broke off goes on where it stopped.
    ``at_once`` trials are suggested and run side by side.
    """
    spark = df.sparkSession
    folded = folded_table(df, spec, target, group, folds, seed)

    def value(params: dict) -> float:
        scores = grouped_cv_scores(folded, boosted_learner(params, positive_weight, seed))
        return scores.agg(F.avg("average_precision")).first()[0]

    trials = search.known_trials(spark, log, study, space)[:n_trials] if log else []
    while len(trials) < n_trials:
        numbers = range(len(trials), min(len(trials) + at_once, n_trials))
        asked = [search.suggest(space, trials, seed, number) for number in numbers]
        values = together(spark, [partial(value, params) for params in asked])
        for number, params, found in zip(numbers, asked, values):
            trials.append((params, found))
            if log:
                search.log_trial(spark, log, study, number, params, found)
    best, found = max(trials, key=lambda t: t[1])
    return SearchResult(best, found, trials)


__all__ = [
    "FittedModel",
    "FoldedTable",
    "TUNED_BOOST",
    "boosted_learner",
    "class_weights",
    "cv_summary",
    "fit_model",
    "folded_table",
    "grouped_cv_scores",
    "logistic_learner",
    "out_of_fold_scores",
    "score",
    "tune",
]
