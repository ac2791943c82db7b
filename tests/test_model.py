import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import attrib, calibrate, conformal, model, prep, score
from riskframe.sources import bundle as bundles
from riskframe.sources.bundle import load_bundle, save_bundle, versions
from riskframe.streaming import streams
from tests.data import signal, signal_rows

SPEC = prep.FeatureSpec(["num1"], ["cat1"])
BOOST = {"n_estimators": 5, "max_depth": 3, "min_child_samples": 5}


@pytest.fixture(scope="module")
def table(spark):
    return signal(spark, 300).cache()


@pytest.fixture(scope="module")
def linear(table):
    return model.fit_model(table, SPEC, "y", model.logistic_learner())


@pytest.fixture(scope="module")
def boosted(table):
    return model.fit_model(table, SPEC, "y", model.boosted_learner(BOOST))


def encoded(df, fitted):
    rows = fitted.encoder.transform(df).orderBy("row_id").select(vector_to_array("features"), "y").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(0,)] * 6, "y int")
    rows = {r.label: r for r in model.class_weights(df, "y").collect()}
    assert (rows[1].balanced, rows[0].balanced) == (2.0, 8 / 12)
    assert (rows[1].positive_ratio, rows[0].positive_ratio) == (3.0, 1.0)


def test_logistic_regression_equals_newton(table, linear):
    x, y = encoded(table, linear)
    n = len(y)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (1 - y).sum()))
    a = np.column_stack([np.ones(n), x])
    ridge = np.diag([0.0] + [1.0] * x.shape[1])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-a @ b))
        b += np.linalg.solve((a * (w * q * (1 - q))[:, None]).T @ a + ridge, a.T @ (w * (y - q)) - ridge @ b)
    got = [linear.classifier.intercept, *linear.classifier.coefficients.toArray()]
    assert np.allclose(got, b, atol=1e-4)


def test_one_class_is_refused(table):
    with pytest.raises(ValueError):
        model.fit_model(table.where("y = 0"), SPEC, "y", model.logistic_learner())


def test_scores_are_probabilities(table, boosted):
    out = model.score(table, boosted)
    assert out.columns == [*table.columns, "p"]
    low, high = out.agg(F.min("p"), F.max("p")).first()
    assert 0 <= low < high <= 1


def test_grouped_cv(table):
    folded = model.folded_table(table, SPEC, "y", "patient_nbr", 3)
    out = model.grouped_cv_scores(folded, model.logistic_learner()).collect()
    assert sorted(r.fold for r in out) == [0, 1, 2]
    assert all(0 <= r.average_precision <= 1 and r.roc_auc > 0.7 and r.brier >= 0 for r in out)


def test_tune(table):
    space = {**model.SEARCH_SPACE, "n_estimators": ("int", 2, 4), "max_depth": ("int", 2, 3)}
    out = model.tune(table, SPEC, "y", "patient_nbr", n_trials=2, folds=2, space=space, at_once=2)
    assert set(out.best_params) == set(space) and 0 <= out.best_value <= 1 and len(out.trials) == 2
    assert out.best_value == max(v for _, v in out.trials)


# --- attributions ------------------------------------------------------------


def expected(nodes, weights, row, known):
    """Log-odds with the unknown features averaged over the training rows."""
    by_id = {(n["tree"], n["node"]): n for n in nodes}

    def at(tree, i):
        n = by_id[tree, i]
        if n["left"] < 0:
            return n["prediction"]
        parts = [by_id[tree, n["left"]], by_id[tree, n["right"]]]
        if n["feature"] in known:
            v = row[n["feature"]]
            left = (v == n["bound"]) if n["one_hot"] else (v <= n["bound"])
            return at(tree, n["left"] if left else n["right"])
        return sum(at(tree, p["node"]) * p["rows"] for p in parts) / n["rows"]

    return sum(2 * w * at(t, 0) for t, w in enumerate(weights))


def test_tree_attributions_are_shapley_values(spark, table, boosted):
    explain = attrib.explainer(boosted)
    nodes = attrib.tree_nodes(spark, boosted.classifier).collect()
    x, _ = encoded(table, boosted)
    width = x.shape[1]
    phi = explain.contributions(x[:12])
    game = lambda row, known: expected(nodes, boosted.classifier.treeWeights, row, known)
    assert np.isclose(explain.base, game(x[0], set()))
    for row, got in zip(x[:12], phi):
        for i in range(width):
            others = [j for j in range(width) if j != i]
            want = 0.0
            for size in range(width):
                for s in itertools.combinations(others, size):
                    share = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
                    want += share * (game(row, {*s, i}) - game(row, set(s)))
            assert np.isclose(got[i], want, atol=1e-9)


def test_deep_trees_with_repeated_features_are_shapley_values():
    """Random trees over few features, against all subsets."""
    rng = np.random.default_rng(3)
    cols = {k: [] for k in ("tree", "feature", "cut", "left", "right", "value", "rows")}

    def node(tree, depth, n):
        at = len(cols["tree"])
        inner = depth < 6 and n > 1 and (depth < 2 or rng.random() < 0.7)
        for k, v in zip(cols, (tree, int(rng.integers(4)) if inner else -1, rng.normal(), -1, -1, rng.normal(), n)):
            cols[k].append(v)
        if inner:
            part = int(rng.integers(1, n))
            cols["left"][at] = node(tree, depth + 1, part)
            cols["right"][at] = node(tree, depth + 1, n - part)
        return at

    for tree in range(4):
        node(tree, 0, 60)
    node(4, 6, 9)  # one leaf
    trees = attrib.PackedTrees(*(np.array(cols[k]) for k in ("tree", "feature", "cut", "left", "right", "value", "rows")))

    def game(row, known, i):
        if trees.left[i] < 0:
            return trees.value[i]
        parts = trees.left[i], trees.right[i]
        if trees.feature[i] in known:
            return game(row, known, parts[0] if row[trees.feature[i]] <= trees.cut[i] else parts[1])
        return sum(game(row, known, p) * trees.rows[p] for p in parts) / trees.rows[i]

    roots = [i for i in range(len(trees.tree)) if i == 0 or trees.tree[i] != trees.tree[i - 1]]
    x = rng.normal(size=(25, 4))
    phi = trees.contributions(x)
    assert np.isclose(trees.base(), sum(game(x[0], set(), r) for r in roots))
    for row, got in zip(x, phi):
        for i in range(4):
            want = 0.0
            for size in range(4):
                for s in itertools.combinations([j for j in range(4) if j != i], size):
                    share = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    want += share * sum(game(row, {*s, i}, r) - game(row, set(s), r) for r in roots)
            assert np.isclose(got[i], want, atol=1e-9)


def test_trees_too_large_to_send_are_refused(boosted, monkeypatch):
    monkeypatch.setattr(attrib, "MAX_BYTES", 100)
    with pytest.raises(ValueError):
        attrib.explainer(boosted)


def test_contribution_rows_add_up(table, boosted, linear):
    for fitted in (boosted, linear):
        explain = attrib.explainer(fitted, table)
        sums = attrib.model_contributions(table, fitted, explain, "row_id").groupBy("row_id").agg(F.sum("contribution").alias("s"))
        both = model.score(table, fitted).join(sums, "row_id").select("p", "s").collect()
        assert len(both) == table.count()
        assert np.allclose([r.s + explain.base for r in both], [math.log(r.p / (1 - r.p)) for r in both])


def test_importance_is_the_mean_of_contributions(table, boosted):
    explain = attrib.explainer(boosted)
    x, _ = encoded(table, boosted)
    want = np.abs(explain.contributions(x)).mean(axis=0)
    got = {r.feature: r.importance for r in attrib.model_importance(table.repartition(5), boosted, explain).collect()}
    assert np.allclose([got[n] for n in boosted.names], want)


def test_linear_explainer_needs_its_background(linear):
    with pytest.raises(ValueError):
        attrib.explainer(linear)


def test_column_reasons(spark):
    df = spark.createDataFrame([(1, 0.5, -2.0, 0.1)], "k int, contrib_a double, contrib_b double, contrib_c double")
    out = df.select(attrib.column_reasons(["a", "b", "c"], 2).alias("r")).first().r
    assert [(r.feature, r.contribution, r.direction) for r in out] == [("b", -2.0, "diminue"), ("a", 0.5, "augmente")]


def test_wide_batches_are_cut():
    assert [s.stop - s.start for s in attrib.batches(2_000_000, 5)] == [2, 2, 1]
    assert attrib.batches(10, 0) == []


# --- scoring -----------------------------------------------------------------


@pytest.fixture(scope="module", params=["boosted", "linear"])
def bundle(request, table):
    base = request.getfixturevalue(request.param)
    raw = model.score(table, base)
    method = "sigmoid" if request.param == "boosted" else "isotonic"
    fit = calibrate.fit_calibration(raw, "p", "y", method)
    _, _, cut = conformal.conformal_threshold(fit.apply(raw, "p", "risk"), "risk", "y", 0.9)
    return score.Bundle(base, fit, cut, 0.9, attrib.explainer(base, table))


def test_score_records(table, bundle):
    rows = score.score_batch(table, bundle, ["row_id"]).collect()
    assert len(rows) == table.count()
    for r in rows:
        assert 0 <= r.risk <= 1 and r.confidence_level == 0.9
        assert r.risk_label in score.LABELS and set(r.prediction_set) <= set(score.LABELS)
        assert r.calibration_method == bundle.calibration.method
        assert 1 <= len(r.top_reasons) <= 5
        sizes = [abs(x.contribution) for x in r.top_reasons]
        assert sizes == sorted(sizes, reverse=True)
        assert all(x.direction == ("augmente" if x.contribution > 0 else "diminue") for x in r.top_reasons)


def test_partial_and_empty_requests_score(spark, bundle):
    df = spark.createDataFrame(
        [(1, {"num1": "1.5", "cat1": "A"}), (2, {}), (3, {"num1": "abc", "else": "1"})], "id int, features map<string,string>"
    )
    rows = score.partial_rows(df, "features", SPEC)
    assert [tuple(r) for r in rows.collect()] == [(1, 1.5, "A"), (2, None, None), (3, None, None)]
    out = {r.id: r for r in score.score_batch(rows, bundle, ["id"]).collect()}
    assert all(0 <= r.risk <= 1 for r in out.values()) and out[2].risk == out[3].risk
    bare = score.score_batch(df.select("id"), bundle).collect()
    assert {r.risk for r in bare} == {out[2].risk}


def test_bundle_round_trip(spark, table, bundle, tmp_path):
    save_bundle(spark, bundle, str(tmp_path / "b"))
    back = load_bundle(spark, str(tmp_path / "b"))
    assert (back.threshold, back.level, back.labels) == (bundle.threshold, bundle.level, list(bundle.labels))
    assert back.model.names == bundle.model.names and back.model.spec == bundle.model.spec
    one, two = (score.score_batch(table, b, ["row_id"]).orderBy("row_id").collect() for b in (bundle, back))
    assert one == two


def test_a_save_that_breaks_off_leaves_the_former_version(spark, table, bundle, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    first = save_bundle(spark, bundle, path)
    second = save_bundle(spark, replace(bundle, threshold=0.123), path)
    assert versions(spark, path) == [first, second]

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(bundles, "_publish", broken)
    with pytest.raises(OSError):
        save_bundle(spark, replace(bundle, threshold=0.9), path)
    assert load_bundle(spark, path).threshold == 0.123
    assert load_bundle(spark, path, first).threshold == bundle.threshold
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, path, "none")
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, str(tmp_path / "empty"))
    # A version whose files were changed is refused.
    spark.createDataFrame([(1,)], "x int").write.mode("overwrite").parquet(f"{path}/versions/{second}/params")
    with pytest.raises(ValueError):
        load_bundle(spark, path)


def test_stream_scores_equal_batch_scores(spark, table, bundle, tmp_path):
    path = str(tmp_path / "in")
    table.write.parquet(path)
    stream = spark.readStream.schema(table.schema).parquet(path)
    out = streams.score_stream(stream, bundle, ["row_id"])
    query = (
        out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("row_id").collect()
    assert got == score.score_batch(table, bundle, ["row_id"]).orderBy("row_id").collect()


def test_data_is_seeded():
    assert signal_rows(5) == signal_rows(5)


def test_rows_a_booster_cannot_tell_apart_are_attributed_once(spark, table, boosted, tmp_path):
    plain, asked = attrib.explainer(boosted), str(tmp_path)

    class Counting(attrib.Explainer):
        def contributions(self, x):
            import uuid

            with open(f"{asked}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(len(x)))
            return super().contributions(x)

    many = table.crossJoin(spark.range(4).withColumnRenamed("id", "copy")).withColumn("row_id", F.expr("row_id * 4 + copy"))
    counting = Counting(plain.names, plain.base, trees=plain.trees)
    got = attrib.model_contributions(many.repartition(7), boosted, counting, "row_id").toPandas()
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) <= table.count()
    rows = attrib.encoded(many, boosted, ["row_id"]).toPandas()
    x = attrib.dense_rows(len(plain.names), rows["_indices"], rows["_values"])
    phi = plain.contributions(x)
    r, c = np.nonzero(phi)
    want = dict(zip(zip(rows["row_id"].to_numpy()[r], np.array(plain.names)[c]), zip(x[r, c], phi[r, c])))
    assert len(got) == len(want)
    for row in got.itertuples():
        assert np.allclose((row.value, row.contribution), want[row.row_id, row.feature], atol=1e-12)


def test_a_tables_reasons_are_found_once_for_rows_alike(spark, table, boosted, tmp_path):
    plain, asked = attrib.explainer(boosted), str(tmp_path)

    class Counting(attrib.Explainer):
        def contributions(self, x):
            import uuid

            with open(f"{asked}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(len(x)))
            return super().contributions(x)

    many = table.crossJoin(spark.range(4).withColumnRenamed("id", "copy")).repartition(7)
    calibration = calibrate.fit_calibration(model.score(table, boosted).select("y", "p"), "p", "y", "sigmoid")
    made = [score.Bundle(boosted, calibration, 0.5, 0.9, e) for e in (plain, Counting(plain.names, plain.base, trees=plain.trees))]
    got = score.score_batch(many, made[1], ["row_id", "copy"]).collect()
    assert len(got) == many.count()
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) <= table.count()
    encoded_rows = boosted.stages.transform(score.with_feature_columns(table, boosted.spec))
    want = {r.row_id: r.r for r in encoded_rows.select("row_id", attrib.reasons_column(plain).alias("r")).collect()}
    assert all(r.top_reasons == want[r.row_id] for r in got)
