import pytest
from pyspark.sql import functions as F

from riskframe.operators import model
from riskframe.plans import encounters as enc
from riskframe.plans import stages
from riskframe.plans.standins import view
from riskframe.sources import bundle, runlog

SF = "/root/testdata/sf0.001"
SMALL = {"n_estimators": 3, "max_depth": 3}


@pytest.fixture(scope="module")
def settings(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    s = stages.Settings(f"{root}/data", f"{root}/models", f"{root}/reports", trials=1, tuning_folds=2, cv_folds=2)
    source = f"{root}/source"
    view(spark, SF, "enc").write.parquet(source)
    stages.ingest_stage(spark, s, source, "parquet")
    return s


def test_profile_and_clean(spark, settings):
    out = stages.profile_stage(spark, settings)
    assert out["shape"].first().n_rows == 1500 and out["findings"].count() == 10
    row = stages.clean_stage(spark, settings).first()
    assert row.rows_out == spark.read.parquet(settings.cleaned).count() < row.rows_in


def test_training_stages(spark, settings):
    stages.clean_stage(spark, settings)
    found = stages.baseline_stage(spark, settings)
    assert {"average_precision_mean", "roc_auc_std", "brier_mean"} <= set(found)
    space = {"n_estimators": ("int", 2, 3), "max_depth": ("int", 2, 3)}
    best, scores = stages.boosting_stage(spark, settings, space)
    assert set(best) == set(space) and 0 <= scores["average_precision_mean"] <= 1


def test_calibrate_and_score(spark, settings, tmp_path):
    stages.clean_stage(spark, settings)
    result, found = stages.calibrate_stage(spark, settings, model.boosted_learner(SMALL))
    assert found["brier_isotonic"] < found["brier_raw"]
    assert 0.8 < found["conformal_coverage"] <= 1
    assert spark.read.parquet(f"{settings.reports_dir}/calibration_curve").where("score_name = 'p'").count() <= 10
    assert bundle.load_bundle(spark, settings.model).threshold == result.threshold
    out = str(tmp_path / "scores")
    stages.score_stage(spark, settings, settings.cleaned, out)
    scored = spark.read.parquet(out)
    assert scored.count() == spark.read.parquet(settings.cleaned).count()
    assert {"risk", "prediction_set", "top_reasons"} <= set(scored.columns)


def test_explain(spark, settings):
    stages.clean_stage(spark, settings)
    out = stages.explain_stage(spark, settings, model.boosted_learner(SMALL))
    assert 0 < out["importance"].count() <= 15 and 0 < out["local"].count() <= 10
    assert {r.attribute for r in out["fairness"].collect()} == set(enc.SUBGROUPS)
    assert spark.read.csv(f"{settings.reports_dir}/fairness", header=True).count() == out["fairness"].count()


def test_drift(spark, settings):
    stages.clean_stage(spark, settings)
    clean = spark.read.parquet(settings.cleaned)
    moved = clean.withColumn("num_medications", F.col("num_medications") * 2).withColumn("gender", F.lit("Female"))
    row = stages.drift_stage(spark, settings, moved).first()
    assert row.retrain == (row.share > 0.2) and row.n_drifted >= 2
    assert stages.drift_stage(spark, settings, clean).first().n_drifted < row.n_drifted
    names = {r.run_name for r in runlog.read_runs(spark, settings.runs).select("run_name").distinct().collect()}
    assert "drift_monitoring" in names
