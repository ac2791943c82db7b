import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors

from riskframe.operators import boost, metrics, model, prep
from tests.data import signal

SPEC = prep.FeatureSpec(["num1"], ["cat1"])
PLAIN = {"n_estimators": 3, "num_leaves": 8, "max_depth": 4, "min_child_samples": 5, "learning_rate": 0.3}


@pytest.fixture(scope="module")
def rows(spark):
    """(features, label) with two numeric slots, one of them often zero, and three 0/1 slots."""
    rng = np.random.default_rng(5)
    out = []
    for _ in range(400):
        a, b, c = round(rng.normal(), 2), round(max(0.0, rng.normal()), 1), int(rng.integers(3))
        y = float(a + 0.8 * b + (c == 1) + rng.normal() > 1.0)
        out.append((Vectors.sparse(5, [0, 1, 2 + c], [a, b, 1.0]), y))
    return spark.createDataFrame(out, ["features", "label"]).repartition(3).cache()


def dense(rows):
    data = [(r["features"].toArray(), r["label"]) for r in rows.collect()]
    return np.array([x for x, _ in data]), np.array([y for _, y in data])


def nodes(fitted):
    from pyspark.sql import SparkSession

    from riskframe.operators import attrib

    return attrib.tree_nodes(SparkSession.active(), fitted).orderBy("tree", "node").toPandas()


def test_first_split_and_leaf_weights_equal_sql(rows):
    params = boost.BoostParams(n_estimators=1, num_leaves=2, min_child_samples=30, learning_rate=1.0, reg_alpha=0.7, reg_lambda=2.5)
    weight = 3.0
    fitted = boost.train(rows, params, weight)
    x, y = dense(rows)
    start = np.log(weight * y.sum() / (1 - y).sum())
    long = pd.DataFrame({"slot": np.tile(np.arange(5), len(y)), "v": x.ravel(), "y": np.repeat(y, 5)})  # noqa: F841
    p = 1 / (1 + np.exp(-start))
    best = duckdb.sql(f"""
        WITH r AS (SELECT slot, v, CASE WHEN y = 1 THEN {weight} ELSE 1 END * ({p} - y) AS g,
                          CASE WHEN y = 1 THEN {weight} ELSE 1 END * {p * (1 - p)} AS h FROM long),
        v AS (SELECT slot, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM r GROUP BY ALL),
        c AS (SELECT slot, v, lead(v) OVER w AS next, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
                     sum(g) OVER (PARTITION BY slot) AS gt, sum(h) OVER (PARTITION BY slot) AS ht, sum(n) OVER (PARTITION BY slot) AS nt
              FROM v WINDOW w AS (PARTITION BY slot ORDER BY v)),
        s AS (SELECT *, greatest(abs(gl) - 0.7, 0) ** 2 / (hl + 2.5) + greatest(abs(gt - gl) - 0.7, 0) ** 2 / (ht - hl + 2.5)
                        - greatest(abs(gt) - 0.7, 0) ** 2 / (ht + 2.5) AS gain
              FROM c WHERE next IS NOT NULL AND nl >= 30 AND nt - nl >= 30)
        SELECT slot, v, next, gain, -sign(gl) * greatest(abs(gl) - 0.7, 0) / (hl + 2.5) AS low,
               -sign(gt - gl) * greatest(abs(gt - gl) - 0.7, 0) / (ht - hl + 2.5) AS high, nl
        FROM s ORDER BY gain DESC, slot, v LIMIT 1""").df().iloc[0]
    got = nodes(fitted)
    root, left, right = got.iloc[0], got.iloc[1], got.iloc[2]
    assert root["feature"] == best["slot"] and best["v"] <= root["bound"] < best["next"]
    assert left["rows"] == best["nl"] and root["rows"] == len(y)
    assert np.allclose([2 * left["prediction"] - start, 2 * right["prediction"] - start], [best["low"], best["high"]])


def leafwise(x, g, h, params, cuts):
    """Best-first growth over exact sums, leaf by leaf: [rows of each leaf]."""

    def score(mask):
        return g[mask].sum() ** 2 / (h[mask].sum() + params.reg_lambda)

    def best(mask, depth):
        found = (0.0, None, None)
        if depth < params.max_depth:
            for f, own in enumerate(cuts):
                for c in own:
                    left = mask & (x[:, f] <= c)
                    right = mask & ~left
                    if min(left.sum(), right.sum()) >= params.min_child_samples:
                        gain = score(left) + score(right) - score(mask)
                        if gain > found[0] + 1e-12:
                            found = (gain, left, right)
        return found

    leaves = [(np.ones(len(g), bool), 0)]
    splits = [best(*leaves[0])]
    while len(leaves) < params.num_leaves:
        at = max(range(len(leaves)), key=lambda i: splits[i][0])
        if splits[at][1] is None:
            break
        _, left, right = splits[at]
        depth = leaves[at][1] + 1
        del leaves[at], splits[at]
        for part in (left, right):
            leaves.append((part, depth))
            splits.append(best(part, depth))
    return [m for m, _ in leaves]


@pytest.mark.parametrize("leaves, depth", [(5, 10), (9, 3), (20, 6)])
def test_trees_grow_best_leaf_first(rows, leaves, depth):
    params = boost.BoostParams(1, 1.0, leaves, depth, 12, reg_lambda=0.3)
    fitted = boost.train(rows, params, 1.0)
    x, y = dense(rows)
    start = np.log(y.sum() / (1 - y).sum())
    p = np.full(len(y), 1 / (1 + np.exp(-start)))
    bins = boost.find_bins(rows, 5)
    want = leafwise(x, p - y, p * (1 - p), params, bins.cuts)
    table = nodes(fitted)
    got = sorted(table.loc[table["left"] < 0, "rows"])
    assert got == sorted(int(m.sum()) for m in want) and len(got) <= leaves
    value = {int(m.sum()): -(p - y)[m].sum() / ((p * (1 - p))[m].sum() + 0.3) + start for m in want}
    for _, r in table[table["left"] < 0].iterrows():
        if got.count(r["rows"]) == 1:
            assert np.isclose(2 * r["prediction"], value[r["rows"]])


def test_blocks_over_executors_give_the_same_trees(rows, monkeypatch):
    params = boost.BoostParams(**PLAIN)
    one = nodes(boost.train(rows, params, 2.0))
    monkeypatch.setattr(boost, "BLOCK_ROWS", 150)
    monkeypatch.setattr(boost, "CHECKPOINT_TREES", 2)
    several = nodes(boost.train(rows, params, 2.0))
    assert one[["tree", "node", "left", "right", "feature", "rows"]].equals(several[["tree", "node", "left", "right", "feature", "rows"]])
    assert np.allclose(one["prediction"], several["prediction"])


@pytest.mark.parametrize(
    "name, value",
    [("n_estimators", 2), ("learning_rate", 0.05), ("num_leaves", 3), ("max_depth", 1), ("min_child_samples", 60),
     ("subsample", 0.6), ("colsample_bytree", 0.4), ("reg_alpha", 4.0), ("reg_lambda", 9.0)],
)
def test_every_parameter_has_effect(rows, name, value):
    key = f"plain-{id(rows)}"
    if key not in _KNOWN:
        _KNOWN[key] = nodes(boost.train(rows, boost.BoostParams(**PLAIN), 1.0))
    other = nodes(boost.train(rows, boost.BoostParams(**{**PLAIN, name: value}), 1.0))
    assert not _KNOWN[key]["prediction"].equals(other["prediction"])
    leaves = other[other["left"] < 0].groupby("tree").size()
    if name == "num_leaves":
        assert leaves.max() == 3
    if name == "n_estimators":
        assert len(leaves) == 2
    if name == "min_child_samples":
        assert other["rows"].min() >= 60


_KNOWN: dict = {}


def test_precision_is_not_below_the_level_wise_booster(spark):
    table = signal(spark, 400)
    train, test = table.where("patient_nbr % 4 <> 0"), table.where("patient_nbr % 4 = 0")

    def precision(learner):
        fitted = model.fit_model(train, SPEC, "y", learner)
        return metrics.average_precision(model.score(test, fitted), "p", "y").first()[0]

    ours = precision(model.boosted_learner({"n_estimators": 40, "num_leaves": 8, "min_child_samples": 20}))
    theirs = precision(lambda r: GBTClassifier(maxIter=40, maxDepth=3, minInstancesPerNode=20, seed=1).fit(r))
    assert ours >= theirs - 0.01


def test_a_table_too_small_to_split_scores_its_rate(spark):
    table = signal(spark, 20)
    fitted = model.fit_model(table, SPEC, "y", model.boosted_learner({"min_child_samples": 500}, positive_weight=1.0))
    rate = table.selectExpr("avg(y)").first()[0]
    assert all(np.isclose(r["p"], rate) for r in model.score(table, fitted).collect())
    with pytest.raises(ValueError):
        model.fit_model(table.where("y = 0"), SPEC, "y", model.boosted_learner({}, positive_weight=1.0))


def test_equal_rows_of_a_large_table_are_boosted_once(spark, rows, monkeypatch):
    many = rows.crossJoin(spark.range(6)).select("features", "label").repartition(3)
    params = boost.BoostParams(**PLAIN)
    columns = ["tree", "node", "left", "right", "feature", "rows"]
    one = nodes(boost.train(many, params, 2.0))
    monkeypatch.setattr(boost, "BLOCK_ROWS", 700)  # fewer than all rows, more than the different ones

    def job(*_):
        raise AssertionError("a job for every pass")

    monkeypatch.setattr(boost, "InJobs", job)
    several = nodes(boost.train(many, params, 2.0))
    assert one[columns].equals(several[columns]) and np.allclose(one["prediction"], several["prediction"])
    # Draws: a root's rows are a share of all rows, others for every tree, the same for another layout.
    drawn = boost.BoostParams(**{**PLAIN, "subsample": 0.6})
    a, b = (nodes(boost.train(many.repartition(p), drawn, 2.0)) for p in (2, 5))
    assert a.equals(b)
    roots = a.loc[a["node"] == 0, "rows"].tolist()
    assert len(set(roots)) > 1 and all(abs(r - 1440) < 5 * np.sqrt(2400 * 0.6 * 0.4) for r in roots)
