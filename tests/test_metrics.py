import numpy as np
import pytest
from riskframe.operators import audit, calibrate, conformal, metrics
from tests.data import scores


def auc(rows):
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def ap(rows):
    total, out, before = sum(y for _, y in rows), 0.0, 0
    for cut in sorted({p for p, _ in rows}, reverse=True):
        above = [y for p, y in rows if p >= cut]
        out += (sum(above) - before) / total * sum(above) / len(above)
        before = sum(above)
    return out


@pytest.mark.parametrize("seed, steps", [(0, 5), (1, 20), (2, 10_000)])
def test_ranking_metrics_equal_brute_force(spark, seed, steps):
    rows = scores(300, seed, steps)
    r = metrics.ranking_metrics(spark.createDataFrame(rows, "p double, y int"), "p", "y").first()
    assert np.isclose(r.roc_auc, auc(rows)) and np.isclose(r.average_precision, ap(rows))
    assert np.isclose(r.brier, np.mean([(p - y) ** 2 for p, y in rows]))
    assert r.n == 300 and np.isclose(r.mean_score, np.mean([p for p, _ in rows]))


def test_metrics_per_group_with_a_third_on_one_score(spark):
    rows = [(g, 0.5 if i % 3 else p, y) for g in "ab" for i, (p, y) in enumerate(scores(200, ord(g)))]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    for r in metrics.ranking_metrics(df, "p", "y", ["g"]).collect():
        same = [(p, y) for g, p, y in rows if g == r.g]
        assert np.isclose(r.roc_auc, auc(same)) and np.isclose(r.average_precision, ap(same))
    assert metrics.brier(df, "p", "y", ["g"]).count() == 2


def test_no_single_task_window(spark):
    df = spark.createDataFrame(scores(), "p double, y int")
    plan = metrics.ranking_metrics(df, "p", "y")._jdf.queryExecution().executedPlan().toString()
    windows = plan.count("Window [")
    assert windows == 2  # one per range, one over the ranges' totals


def test_summary(spark):
    df = spark.createDataFrame([(0, 0.2, 0.6, 0.1), (1, 0.4, 0.8, 0.3)], "fold int, average_precision double, roc_auc double, brier double")
    out = {r.metric: (r["mean"], r["std"]) for r in metrics.cv_summary(df).collect()}
    assert np.allclose(out["average_precision"], (0.3, 0.1)) and np.allclose(out["brier"], (0.2, 0.1))


def test_coverage_and_size(spark):
    df = spark.createDataFrame([([0, 1], 0), ([1], 1), ([0], 1)], "s array<int>, y int")
    r = metrics.coverage_and_size(df, "s", "y").first()
    assert np.isclose(r.coverage, 2 / 3) and np.isclose(r.mean_size, 4 / 3)


def test_calibration_curve(spark):
    rows = scores(500, 7, 37)
    got = {
        r.bin: (r.n, r.mean_predicted, r.observed_rate)
        for r in metrics.calibration_curve(spark.createDataFrame(rows, "p double, y int"), ["p"], "y").collect()
    }
    p, y = np.array(rows).T
    edges = np.percentile(p, np.linspace(0, 1, 11) * 100)
    place = np.searchsorted(edges[1:-1], p)
    assert set(got) == set(place.tolist())
    for b, (n, mean, rate) in got.items():
        assert n == (place == b).sum() and np.isclose(mean, p[place == b].mean()) and np.isclose(rate, y[place == b].mean())


# --- audit -------------------------------------------------------------------


def test_subgroups(spark):
    rows = [("M", 1, 0.9), ("M", 0, 0.2), ("F", 1, 0.8), ("F", 0, 0.3), ("F", 1, 0.7), ("M", 0, 0.1), (None, 1, 0.5)]
    df = spark.createDataFrame(rows, "gender string, y int, p double")
    out = {r.subgroup: r for r in audit.subgroup_metrics(df, "y", "p", ["gender"]).collect()}
    assert set(out) == {"M", "F"} and out["F"].n == 3
    assert out["F"].actual_rate == 0.667 and out["F"].mean_risk == 0.6
    assert all(r.roc_auc is not None for r in out.values())


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("A", 1, 0.6), ("A", 1, 0.7)], "g string, y int, p double")
    assert audit.subgroup_metrics(df, "y", "p", ["g"]).first().roc_auc is None


def test_gap_needs_two_large_groups(spark):
    rows = [("a", "x", 300, 0.7), ("a", "y", 250, 0.6), ("a", "z", 10, 0.1), ("b", "x", 900, 0.5), ("b", "y", 900, None)]
    df = spark.createDataFrame(rows, "attribute string, subgroup string, n long, roc_auc double")
    out = audit.subgroup_gap(df).collect()
    assert [(r.attribute, round(r.auc_gap, 6), r.n_groups) for r in out] == [("a", 0.1, 2)]


# --- calibration -------------------------------------------------------------


def platt(p, t, steps=50):
    x = np.column_stack([np.ones_like(p), p])
    b = np.zeros(2)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (t - q))
    return b


def test_sigmoid_equals_newton(spark):
    rows = scores(400, 3, 50)
    p, y = np.array(rows).T
    n1, n0 = y.sum(), (1 - y).sum()
    offset, slope = platt(p, np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)))
    fit = calibrate.fit_sigmoid(spark.createDataFrame(rows, "p double, y int"), "p", "y")
    assert np.allclose([-fit.offset, -fit.slope], [offset, slope], atol=1e-5)


def test_isotonic_equals_pooling(spark):
    rows = scores(400, 4, 15)
    df = spark.createDataFrame(rows, "p double, y int")
    out = calibrate.fit_isotonic(df, "p", "y").apply(df.select("p").distinct(), "p", "c").orderBy("p").collect()
    levels = sorted({p for p, _ in rows})
    s = np.array([sum(y for p, y in rows if p == v) for v in levels])
    w = np.array([sum(1 for p, _ in rows if p == v) for v in levels])
    means = lambda a, b: s[a : b + 1].sum() / w[a : b + 1].sum()
    want = [max(min(means(a, b) for b in range(i, len(levels))) for a in range(i + 1)) for i in range(len(levels))]
    assert np.allclose([r.c for r in out], want)


def test_isotonic_clips_outside(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 1)], "p double, y int")
    fit = calibrate.fit_isotonic(df, "p", "y")
    probe = spark.createDataFrame([(0.0,), (0.3,), (0.9,)], "p double")
    assert np.allclose([r.c for r in fit.apply(probe, "p", "c").collect()], [0, 0.5, 1])


def test_lowest_brier_wins(spark):
    df = spark.createDataFrame([(1, 0.9, 0.6), (0, 0.2, 0.4)], "y int, isotonic double, sigmoid double")
    table = calibrate.brier_by_method(df, "y", {m: m for m in calibrate.METHODS})
    assert calibrate.select_method(table).first().method == "isotonic"


# --- conformal ---------------------------------------------------------------


@pytest.mark.parametrize("n, rank", [(1, 1), (9, 9), (10, 10), (19, 18), (29, 27), (100, 91)])
def test_rank(n, rank):
    assert conformal.threshold_rank(n, 0.9) == rank


def test_threshold_is_the_order_statistic(spark):
    rows = scores(333, 5, 1000)
    n, rank, cut = conformal.conformal_threshold(spark.createDataFrame(rows, "p double, y int"), "p", "y", 0.9)
    s = sorted(1 - (p if y else 1 - p) for p, y in rows)
    assert (n, rank) == (333, 301) and np.isclose(cut, s[300])


def test_coverage_holds_on_exchangeable_rows(spark):
    rows = scores(4000, 6, 1000)
    df = spark.createDataFrame(rows, "p double, y int")
    _, _, cut = conformal.conformal_threshold(df.limit(2000), "p", "y", 0.9)
    out = conformal.with_prediction_set(df, "p", cut)
    assert metrics.coverage_and_size(out, "prediction_set", "y").first().coverage > 0.87


def test_sets_can_be_empty_one_or_both(spark):
    df = spark.createDataFrame([(0.9,), (0.5,)], "p double")
    sets = lambda t: [r.s for r in conformal.with_prediction_set(df, "p", t, ("no", "yes"), "s").collect()]
    assert sets(0.6) == [["yes"], ["no", "yes"]] and sets(0.3) == [["yes"], []]


def test_empty_conform_split(spark):
    with pytest.raises(ValueError):
        conformal.conformal_threshold(spark.createDataFrame([], "p double, y int"), "p", "y")


def test_labels_as_names(spark):
    df = spark.createDataFrame([(["a"], "a"), (["b"], "a")], "s array<string>, y string")
    assert metrics.coverage_and_size(df, "s", "y").first().coverage == 0.5
