import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import drift
from riskframe.plans.encounters import AGE_BUCKETS, STRESS


def encounters(spark, n=500):
    rng = random.Random(0)
    rows = [
        (i, rng.randint(1, 9), rng.randint(1, 19), rng.randint(0, 2), rng.choice(AGE_BUCKETS[4:7]), rng.choice(["Cardiology", "Surgery"]))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "encounter_id long, time_in_hospital int, num_medications int, number_inpatient int, age string, "
        "medical_specialty string",
    )


def test_stress_moves_distributions_within_bounds(spark):
    df = encounters(spark)
    out = drift.stress(df, "encounter_id", STRESS, seed=1)
    assert out.schema == df.schema or out.dtypes == df.dtypes
    mean = lambda d: d.agg(F.avg("num_medications")).first()[0]
    assert mean(out) > mean(df)
    blank = out.where("medical_specialty IS NULL").count() / 500
    assert 0.12 < blank < 0.28
    assert out.where("NOT time_in_hospital BETWEEN 1 AND 14").count() == 0
    moved = df.join(out.withColumnRenamed("age", "aged"), "encounter_id").where("age <> aged").count() / 500
    assert 0.17 < moved < 0.33


def test_stress_is_the_same_for_any_partitioning(spark):
    df = encounters(spark)
    a = drift.stress(df.repartition(7), "encounter_id", STRESS, 3)
    assert a.exceptAll(drift.stress(df, "encounter_id", STRESS, 3)).count() == 0


def test_stress_without_intensity_changes_nothing(spark):
    df = encounters(spark)
    assert drift.stress(df, "encounter_id", STRESS, 3, intensity=0.0).exceptAll(df).count() == 0


def test_missing_values_stay_missing(spark):
    df = spark.createDataFrame([(1, None, None)], "k long, age string, time_in_hospital int")
    row = drift.stress(df, "k", STRESS, 0).first()
    assert row.age is None and row.time_in_hospital is None


def w1(a, b):
    xs = np.sort(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    g = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    return np.sum(np.abs(f - g)[:-1] * np.diff(xs)), np.max(np.abs(f - g))


def sides(spark, seed=0):
    rng = random.Random(seed)
    ref = [(round(rng.gauss(0, 1), 2), rng.choice("aab")) for _ in range(1200)]
    cur = [(round(rng.gauss(0.3, 1.2), 2), rng.choice("abbc")) for _ in range(900)]
    return ref, cur, *[spark.createDataFrame(r, "x double, c string") for r in (ref, cur)]


def test_numeric_distances_equal_numpy(spark):
    ref, cur, a, b = sides(spark)
    r = drift.numeric_drift(a, b, ["x"]).first()
    x, y = np.array([v for v, _ in ref]), np.array([v for v, _ in cur])
    area, ks = w1(x, y)
    assert np.isclose(r.wasserstein, area / x.std()) and np.isclose(r.ks, ks)


def test_category_distances(spark):
    ref, cur, a, b = sides(spark)
    r = drift.category_drift(a, b, ["c"]).first()
    p = np.array([sum(c == v for _, c in ref) for v in "abc"]) / len(ref)
    q = np.array([sum(c == v for _, c in cur) for v in "abc"]) / len(cur)
    m = (p + q) / 2
    js = sum(u * math.log(u / w) for u, w in zip(p, m) if u) / 2 + sum(u * math.log(u / w) for u, w in zip(q, m) if u) / 2
    assert np.isclose(r.js_distance, math.sqrt(js)) and math.isinf(r.chi2) and r.n_levels == 3
    two = drift.category_drift(a, b, ["c"], base=2).first()
    assert np.isclose(two.js_distance, math.sqrt(js / math.log(2)))


def test_same_table_does_not_drift(spark):
    _, _, a, _ = sides(spark)
    rows = drift.drift_report(a, a, ["x"], ["c"], "distance").collect()
    assert {(r.test, r.statistic, r.drifted) for r in rows} == {("wasserstein", 0.0, False), ("jensen_shannon", 0.0, False)}


def test_report_by_tests_at_the_callers_word(spark):
    _, _, a, b = sides(spark)
    assert {r.test for r in drift.drift_report(a.limit(500), b, ["x"], ["c"], "distance").collect()} == {"wasserstein", "jensen_shannon"}
    rows = {r.column_name: r for r in drift.drift_report(a.limit(500), b, ["x"], ["c"], method="test").collect()}
    assert rows["x"].test == "ks" and rows["c"].test == "chi_square"
    assert rows["c"].p_value == 0.0 and rows["c"].drifted


def test_two_levels_use_proportions(spark):
    a = spark.createDataFrame([("y",)] * 30 + [("n",)] * 70, "c string")
    b = spark.createDataFrame([("y",)] * 50 + [("n",)] * 50, "c string")
    r = drift.drift_report(a, b, [], ["c"], method="test").first()
    z = 0.2 / math.sqrt(0.4 * 0.6 * (2 / 100))
    assert r.test == "z_test" and np.isclose(r.p_value, math.erfc(z / math.sqrt(2))) and r.drifted


@pytest.mark.parametrize("x, dof, p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (19.67513757268249, 11, 0.05)])
def test_chi_square_tail(x, dof, p):
    assert np.isclose(drift._upper_tail(x, dof), p)


def test_ks_tail():
    assert np.isclose(drift._ks_tail(1.3581 / math.sqrt(50), 100, 100), 0.05, atol=1e-4)


def test_the_caller_names_the_kind(spark):
    a = spark.createDataFrame([(i % 4,) for i in range(1500)], "n int")
    b = spark.createDataFrame([(i % 3,) for i in range(1500)], "n int")
    assert drift.drift_report(a, b, ["n"], [], "distance").first().test == "wasserstein"
    assert drift.drift_report(a, b, [], ["n"], "distance").first().test == "jensen_shannon"


def test_share_and_decision(spark):
    report = spark.createDataFrame([(True,), (True,), (False,), (False,), (False,)], "drifted boolean")
    share = drift.drift_share(report)
    assert share.first().asDict() == {"share": 0.4, "n_drifted": 2}
    decide = lambda t: drift.retraining_decision(share, t).first()
    assert decide(0.3).retrain is True and "40%" in decide(0.3).message
    assert decide(0.4).retrain is False and decide(0.5).retrain is False


def test_nothing_compared(spark):
    share = drift.drift_share(spark.createDataFrame([], "drifted boolean"))
    row = drift.retraining_decision(share).first()
    assert math.isnan(row.share) and row.n_drifted == 0 and row.retrain is False


def test_small_sample_tail_equals_an_enumeration():
    """All orders of two samples, their distances counted."""
    for n, m in ((3, 4), (5, 5), (4, 6)):
        found = []
        for places in itertools.combinations(range(n + m), n):
            a = b = 0
            gap = 0.0
            for i in range(n + m):
                a, b = a + (i in places), b + (i not in places)
                gap = max(gap, abs(a / n - b / m))
            found.append(gap)
        for d in sorted(set(found)):
            want = sum(g >= d - 1e-12 for g in found) / len(found)
            assert math.isclose(drift.ks_tail(d, n, m), want, rel_tol=1e-9)
            assert math.isclose(drift.ks_tail(d, m, n), want, rel_tol=1e-9)


def test_exact_tail_meets_the_asymptotic_one():
    for n, m, d in ((900, 1_000, 0.06), (3_000, 2_500, 0.04), (1_000, 1_000, 0.15)):
        assert math.isclose(drift.ks_tail(d, n, m), drift._ks_tail(d, n, m), rel_tol=0.1)
    assert drift.ks_tail(1.0, 40, 40) < 1e-12 and drift.ks_tail(0.0, 40, 40) == 1.0


def test_choice_by_rows_and_levels(spark):
    def side(n, shift):
        rows = [(float(i % 97) + shift, i % 3, "ab"[i % 2], "xyz"[i % 3]) for i in range(n)]
        return spark.createDataFrame(rows, "wide double, few int, two string, three string")

    def kinds(n):
        report = drift.drift_report(side(n, 0.0), side(n // 2, 5.0), ["wide", "few"], ["two", "three"])
        return {r.column_name: (r.test, r.p_value is None) for r in report.collect()}

    assert kinds(900) == {"wide": ("ks", False), "few": ("chi_square", False), "two": ("z_test", False), "three": ("chi_square", False)}
    far = {"wide": ("wasserstein", True), **{c: ("jensen_shannon", True) for c in ("few", "two", "three")}}
    assert kinds(1_200) == far
