"""The stages of the work, each reading and writing tables.

ingest -> profile -> clean -> baseline -> boosting -> calibrate -> explain ->
score -> drift
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.operators import attrib, audit, calibrate, clean, conformal, contract, drift, metrics, model, prep, profile
from riskframe.operators import score as scoring
from riskframe.operators import split
from riskframe.plans import encounters as enc
from riskframe.session import materialize
from riskframe.sources import bundle as bundles
from riskframe.sources import runlog, tables


@dataclass(frozen=True)
class Settings:
    """Folders and parameters of a run; every folder must be shared storage."""

    data_dir: str
    models_dir: str
    reports_dir: str
    target: str = enc.TARGET
    group: str = enc.GROUP
    key: str = enc.KEY
    test_size: float = 0.2
    seed: int = split.SEED
    cv_folds: int = 5
    trials: int = model.TRIALS
    tuning_folds: int = model.TUNING_FOLDS
    trials_at_once: int = 1
    confidence: float = conformal.LEVEL
    drift_threshold: float = drift.DRIFT_SHARE

    @property
    def raw(self) -> str:
        return f"{self.data_dir}/diabetic_data.parquet"

    @property
    def cleaned(self) -> str:
        return f"{self.data_dir}/diabetic_clean.parquet"

    @property
    def model(self) -> str:
        return f"{self.models_dir}/model"

    @property
    def runs(self) -> str:
        return f"{self.reports_dir}/runs"


def ingest_stage(spark: SparkSession, s: Settings, source: str, fmt: str = "csv", force: bool = False) -> str:
    return tables.ingest(spark, source, s.raw, fmt, force=force)


def profile_stage(spark: SparkSession, s: Settings) -> dict[str, DataFrame]:
    """Shape, contract findings, label counts and missing shares of the raw table."""
    raw = tables.load_raw(spark, s.raw)
    rules = enc.CLEAN
    return {
        "shape": profile.table_shape(raw, s.group),
        "findings": contract.first_findings(contract.contract_findings(raw, enc.CONTRACT)),
        "labels": profile.value_counts(raw, rules.label_column),
        "positive_rate": profile.positive_rate(raw, F.col(rules.label_column) == rules.positive_value),
        "missing": profile.top_missing(raw, rules.token),
    }


def clean_stage(spark: SparkSession, s: Settings) -> DataFrame:
    """Write the clean table; returns its metrics."""
    raw = tables.load_raw(spark, s.raw)
    tables.write_table(clean.clean(raw, enc.CLEAN), s.cleaned)
    return clean.clean_metrics(raw, enc.CLEAN)


def _train_test(spark: SparkSession, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Both sides of the hold-out, tagged once and written."""
    df = tables.load_clean(spark, s.cleaned)
    k = split.folds_for_share(s.test_size)
    tagged = materialize(split.with_folds(df, s.group, s.target, k, s.seed, "_side"), "holdout")
    return tagged.where("_side <> 0").drop("_side"), tagged.where("_side = 0").drop("_side")


def _spec(df: DataFrame, s: Settings) -> prep.FeatureSpec:
    return prep.feature_spec(df, s.target, enc.NUMERIC_COLUMNS, [s.key, s.group])


def _cv(train: DataFrame, spec: prep.FeatureSpec, s: Settings, learner: model.Learner) -> dict[str, float]:
    folded = model.folded_table(train, spec, s.target, s.group, s.cv_folds, s.seed)
    summary = metrics.cv_summary(model.grouped_cv_scores(folded, learner)).collect()  # one row per metric
    return {f"{r['metric']}_{part}": r[part] for r in summary for part in ("mean", "std")}


def baseline_stage(spark: SparkSession, s: Settings) -> dict[str, float]:
    """Grouped cross-validation of the logistic regression on the train side."""
    train, _ = _train_test(spark, s)
    spec = _spec(train, s)
    found = _cv(train, spec, s, model.logistic_learner())
    params = {
        "model": "logistic_regression",
        "class_weight": "balanced",
        "n_numeric": len(spec.numeric),
        "n_categorical": len(spec.categorical),
        "n_constant_dropped": len(spec.constant),
        "cv_folds": s.cv_folds,
    }
    runlog.log_run(spark, s.runs, "baseline", params, found)
    return found


def boosting_stage(
    spark: SparkSession, s: Settings, space: Mapping[str, tuple] = model.SEARCH_SPACE
) -> tuple[dict, dict[str, float]]:
    """Search, then cross-validate the best parameters on the baseline's folds.

    Trials are logged one by one; a stage that is run again goes on after the last.
    """
    train, _ = _train_test(spark, s)
    spec = _spec(train, s)
    found = model.tune(
        train, spec, s.target, s.group, s.trials, s.tuning_folds, s.seed, space, log=s.runs, study="boosting", at_once=s.trials_at_once
    )
    scores = _cv(train, spec, s, model.boosted_learner(found.best_params, seed=s.seed))
    params = {"model": "boosted_trees", "n_trials": s.trials, "tuning_folds": s.tuning_folds, **found.best_params}
    runlog.log_run(spark, s.runs, "boosting", params, {**scores, "tuning_best": found.best_value})
    return found.best_params, scores


def calibrate_stage(
    spark: SparkSession, s: Settings, learner: model.Learner | None = None
) -> tuple[scoring.Bundle, dict[str, float]]:
    """Fit, calibrate, conformalise, report on the test side, save the bundle.

    The calibration method is chosen on a held-back fifth of the calib rows,
    not on the test side.
    """
    train, test = _train_test(spark, s)
    fit, calib, conform = (
        materialize(part, name)
        for part, name in zip(split.three_way_split(train, s.target, s.group, s.seed), ("fit", "calib", "conform"))
    )
    spec = _spec(fit, s)
    learner = learner or model.boosted_learner(model.TUNED_BOOST, seed=s.seed)
    base = model.fit_model(fit, spec, s.target, learner)

    calib_scores = materialize(
        model.score(calib, base).select(s.group, F.col(s.target).alias("y"), "p"), "calib_scores"
    )
    kept, held = split.holdout_split(calib_scores, "y", s.group, 0.2, s.seed)
    candidates = {m: calibrate.fit_calibration(kept, "p", "y", m) for m in calibrate.METHODS}
    trial = held
    for name, c in candidates.items():
        trial = c.apply(trial, "p", name)
    best = calibrate.select_method(calibrate.brier_by_method(trial, "y", {m: m for m in candidates})).first()["method"]
    chosen = calibrate.fit_calibration(calib_scores, "p", "y", best)

    conform_scores = chosen.apply(model.score(conform, base), "p", "risk").select(s.target, "risk")
    _, _, threshold = conformal.conformal_threshold(conform_scores, "risk", s.target, s.confidence)

    tested = model.score(test, base).select(s.target, "p")
    for name in candidates:
        tested = calibrate.fit_calibration(calib_scores, "p", "y", name).apply(tested, "p", name)
    tested = materialize(conformal.with_prediction_set(tested, best, threshold), "tested")
    briers = calibrate.brier_by_method(tested, s.target, {"raw": "p", **{m: m for m in candidates}}).collect()
    cover = conformal_report(tested, s.target)
    found = {f"brier_{r['method']}": r["brier"] for r in briers} | cover
    tables.write_table(metrics.calibration_curve(tested, ["p", best], s.target), f"{s.reports_dir}/calibration_curve")

    result = scoring.Bundle(base, chosen, threshold, s.confidence, attrib.explainer(base, fit))
    bundles.save_bundle(spark, result, s.model)
    params = {"calibration_method": best, "conformity_score": "lac", "confidence_level": s.confidence}
    runlog.log_run(spark, s.runs, "calibrated_conformal", params, found)
    return result, found


def conformal_report(df: DataFrame, target: str) -> dict[str, float]:
    row = metrics.coverage_and_size(df, "prediction_set", target).first()
    return {"conformal_coverage": row["coverage"], "conformal_set_size": row["mean_size"]}


def explain_stage(
    spark: SparkSession, s: Settings, learner: model.Learner | None = None
) -> dict[str, DataFrame]:
    """Importance, effects, the highest-risk row's reasons, and the audit."""
    train, test = _train_test(spark, s)
    spec = _spec(train, s)
    fitted = model.fit_model(train, spec, s.target, learner or model.boosted_learner(model.TUNED_BOOST, seed=s.seed))
    explain = attrib.explainer(fitted, train)

    scored = materialize(model.score(test, fitted), "test_scores")
    long = materialize(attrib.model_contributions(scored, fitted, explain, s.key), "contributions")
    importance = attrib.model_importance(scored, fitted, explain)
    top = attrib.highest_risk(scored, "p", s.key).select(s.key)
    local = attrib.largest_contributions(long.join(F.broadcast(top), s.key, "left_semi"))  # one row

    fairness = audit.subgroup_metrics(scored, s.target, "p", [c for c in enc.SUBGROUPS if c in scored.columns])
    tables.write_csv(fairness, f"{s.reports_dir}/fairness")
    ap = metrics.average_precision(scored, "p", s.target).first()[0]
    runlog.log_run(spark, s.runs, "explain_fairness", {}, {"test_average_precision": ap})
    return {
        "importance": importance,
        "detail": attrib.effect_detail(long, importance),
        "local": local,
        "fairness": fairness,
        "gap": audit.subgroup_gap(fairness),
    }


def score_stage(spark: SparkSession, s: Settings, source: str, out: str) -> None:
    """Score a table of encounters with the saved bundle."""
    bundle = bundles.load_bundle(spark, s.model)
    tables.write_table(scoring.score_batch(tables.load_clean(spark, source), bundle), out)


def drift_stage(spark: SparkSession, s: Settings, current: DataFrame) -> DataFrame:
    """Compare a current clean table with the train side over all rows; returns the decision."""
    train, _ = _train_test(spark, s)
    spec = _spec(train, s)
    report = materialize(drift.drift_report(train, current, spec.numeric, spec.categorical), "drift")
    tables.write_table(report, f"{s.reports_dir}/drift")
    decision = materialize(drift.retraining_decision(drift.drift_share(report), s.drift_threshold), "decision")
    row = decision.first()
    found = {"drift_share": row["share"], "drifted_columns": row["n_drifted"]}
    runlog.log_run(spark, s.runs, "drift_monitoring", {"retraining_triggered": row["retrain"]}, found)
    return decision
