import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import prep

IDS = ["encounter_id", "patient_nbr"]


def features(spark):
    return spark.createDataFrame(
        [
            (1, 10, 3, "Caucasian", 1, "No", 0),
            (2, 20, 5, "Asian", 1, "No", 1),
            (3, 30, 2, None, 2, "No", 0),
            (4, 40, 8, "Caucasian", 3, "No", 1),
        ],
        "encounter_id long, patient_nbr long, time_in_hospital int, race string, admission_type_id int, "
        "examide string, readmitted_30d int",
    )


def spec_of(df):
    return prep.feature_spec(df, "readmitted_30d", ["time_in_hospital"], IDS)


def matrix(model, df, key="encounter_id"):
    rows = model.transform(df).orderBy(key).select(vector_to_array("features")).collect()
    return np.array([r[0] for r in rows])


def test_spec(spark):
    spec = spec_of(features(spark))
    assert spec.numeric == ["time_in_hospital"]
    assert spec.categorical == ["race", "admission_type_id"]
    assert spec.constant == ["examide"]


def test_missing_counts_as_a_level_for_constants(spark):
    df = spark.createDataFrame([(None, None, "a", "a"), (None, 1, "a", "b")], "x int, y int, z string, w string")
    out = {r.column_name: r.is_constant for r in prep.constant_columns(df, df.columns).collect()}
    assert out == {"x": True, "y": False, "z": True, "w": False}


def test_encoding_has_no_nan_and_keeps_its_width(spark):
    df = features(spark)
    spec = spec_of(df)
    model = prep.TabularPrep(spec, 1).fit(df)
    x = matrix(model, df)
    assert x.shape == (4, 1 + 3 + 3) and not np.isnan(x).any()
    new = df.withColumn("race", F.when(F.col("encounter_id") == 1, "Hispanic").otherwise(F.col("race")))
    y = matrix(model, new)
    assert y.shape == x.shape
    assert y[0, 1:4].sum() == 0 and (y[1:] == x[1:]).all()
    check = prep.encoded_check(model, {"train": df, "test": new}).collect()
    assert {(r.min_width, r.max_width, r.n_nan) for r in check} == {(7, 7, 0)}


def test_numbers_use_the_median_and_population_deviation(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0), (5, None)], "encounter_id long, x double")
    stats = prep.numeric_stats(df, ["x"])["all"]["x"]
    filled = np.array([1, 2, 3, 10, 2.5])
    assert stats.median == 2.5
    assert np.isclose(stats.mean, filled.mean()) and np.isclose(stats.std, filled.std())
    out = prep.impute_and_scale(df, {"x": stats}).orderBy("encounter_id").collect()
    assert np.allclose([r.x for r in out], (filled - filled.mean()) / filled.std())
    model = prep.TabularPrep(prep.FeatureSpec(["x"], [])).fit(df)
    assert np.allclose(matrix(model, df)[:, 0], (filled - filled.mean()) / filled.std())


def test_zero_deviation_counts_as_one(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 4.0)], "encounter_id long, x double")
    assert prep.numeric_stats(df, ["x"])["all"]["x"].std == 1.0


def levels(spark):
    rows = [(i, v) for i, v in enumerate(["a"] * 12 + ["b"] * 10 + ["c"] * 9 + ["d"] * 2 + [None] * 3)]
    return spark.createDataFrame(rows, "encounter_id long, c string")


def test_rare_levels_share_a_slot_and_unseen_have_none(spark):
    df = levels(spark)
    spec = prep.FeatureSpec([], ["c"])
    stats = prep.fit_stats(df, spec)["all"]
    assert prep.feature_names(spec, stats) == ["c_a", "c_b", "c_infrequent"]
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "zzz"), (4, None)], "encounter_id long, c string")
    x = matrix(prep.encoder(spark, spec, stats), new)
    assert x.tolist() == [[1, 0, 0], [0, 0, 1], [0, 0, 0], [0, 0, 1]]


def test_joined_rare_levels_encode_alike(spark, tmp_path):
    df = levels(spark)
    spec = prep.FeatureSpec([], ["c"])
    joined = prep.fit_stats(df, spec, max_indexed_rare=1)["all"]
    assert joined.rare_table is not None and joined.levels["c"].rare == []
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "zzz"), (4, None)], "encounter_id long, c string")
    model = prep.encoder(spark, spec, joined)
    want = matrix(prep.encoder(spark, spec, prep.fit_stats(df, spec)["all"]), new)
    assert (matrix(model, new) == want).all()
    model.write().save(str(tmp_path / "m"))
    assert (matrix(PipelineModel.load(str(tmp_path / "m")), new) == want).all()


def test_no_infrequent_slot_without_rare_levels(spark):
    df = levels(spark).where("c IN ('a', 'b')")
    spec = prep.FeatureSpec([], ["c"])
    assert prep.feature_names(spec, prep.fit_stats(df, spec)["all"]) == ["c_a", "c_b"]


def test_width_is_checked_before_collecting(spark):
    with pytest.raises(ValueError, match="min_frequency"):
        prep.fit_stats(levels(spark), prep.FeatureSpec([], ["c"]), min_frequency=1, max_width=3)


def test_codes_are_categories(spark):
    df = spark.createDataFrame([(i, i % 2 or None) for i in range(40)], "encounter_id long, code int")
    spec = prep.FeatureSpec([], ["code"])
    stats = prep.fit_stats(df, spec)["all"]
    assert prep.feature_names(spec, stats) == ["code_1", "code_Missing"]


def test_odd_names_and_levels(spark):
    df = spark.createDataFrame([(i, "it's `x`", "o'k") for i in range(20)], "encounter_id long, `a b` string, c string")
    spec = prep.FeatureSpec([], ["a b", "c"])
    assert matrix(prep.TabularPrep(spec).fit(df), df).tolist() == [[1.0, 1.0]] * 20


def test_fold_sets_equal_separate_fits(spark):
    rows = [(i, float(i * i % 17) if i % 5 else None, "xyz"[i % 3], i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "encounter_id long, n double, c string, fold int")
    spec = prep.FeatureSpec(["n"], ["c"])
    together = prep.fit_stats(df, spec, prep.training_sets("fold", 4))
    for k in range(4):
        alone = prep.fit_stats(df.where(F.col("fold") != k), spec)["all"]
        assert together[str(k)].levels == alone.levels
        a, b = together[str(k)].numeric["n"], alone.numeric["n"]
        assert np.allclose([a.median, a.mean, a.std], [b.median, b.mean, b.std])


def test_estimator_in_a_pipeline(spark):
    df = features(spark)
    model = Pipeline(stages=[prep.TabularPrep(spec_of(df), 1)]).fit(df)
    assert "features" in model.transform(df).columns
