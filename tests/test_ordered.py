import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import ordered
from riskframe.operators.keyed import attach_by_key


@pytest.mark.parametrize(
    "seed, grid, bracket, margins",
    [(0, 2000, 10**6, (1, 50, 2000)), (1, 20, 10, (1, 5, 20)), (3, 5, 3, (0, 1, 5))],
)
def test_quantiles_equal_numpy(spark, seed, grid, bracket, margins, monkeypatch):
    """Also with sketches inside brackets, and with brackets that miss."""
    monkeypatch.setattr(ordered, "GRID", grid)
    monkeypatch.setattr(ordered, "BRACKET_ROWS", bracket)
    monkeypatch.setattr(ordered, "MARGINS", margins)
    rng = random.Random(seed)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 3)) if rng.random() < 0.8 else None, i % 3) for i in range(701)]
    df = spark.createDataFrame(rows, "a double, b double, s int")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    sets = {"all": F.lit(True), "some": F.col("s") != 1}
    out = ordered.exact_quantiles(df, ["a", "b"], shares, sets)
    for name, keep in (("all", lambda r: True), ("some", lambda r: r[2] != 1)):
        for i, c in enumerate("ab"):
            want = np.quantile([r[i] for r in rows if keep(r) and r[i] is not None], shares)
            assert np.allclose(out[name, c], want, atol=1e-12)


def test_ranks_outside_their_bracket_are_looked_for_again(spark, monkeypatch):
    narrowed = ordered._narrowed

    def wrong_at_first(b, below, inside, grid, margin):
        if margin == ordered.MARGINS[0]:
            return [ordered._Bracket(b.set_name, b.column, list(b.ranks), 7.0, 8.0)]
        return narrowed(b, below, inside, grid, margin)

    monkeypatch.setattr(ordered, "_narrowed", wrong_at_first)
    df = spark.createDataFrame([(float(i),) for i in range(100)], "a double")
    assert ordered.exact_quantiles(df, ["a"], [0.0, 0.07, 0.5, 1.0])["all", "a"] == [0.0, 6.930000000000001, 49.5, 99.0]


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert ordered.exact_quantiles(df, ["a"], [0.5]) == {("all", "a"): [None]}


def test_one_value_holding_most_rows(spark):
    df = spark.createDataFrame([(1.0,)] * 900 + [(float(i),) for i in range(100)], "a double")
    found, n, _ = ordered.values_at_ranks(df, ["a"], lambda *_: [0, 1, 500, 999])
    assert found["all", "a"] == {0: 0.0, 1: 1.0, 500: 1.0, 999: 99.0} and n["all", "a"] == 1000


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_totals(spark, descending, groups):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.randint(0, 60) / 7, rng.randint(1, 5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    cuts = ordered.range_cuts(df, ["v"], 6)
    levels = ordered.with_ranges(df, cuts, {"v": ordered.BUCKET}).groupBy(*groups, ordered.BUCKET, "v").agg(F.sum("n").alias("n"))
    got = ordered.running_totals(levels, "v", ["n"], groups, descending, "nxt").collect()
    for r in got:
        same = [x for x in rows if not groups or x[0] == r["g"]]
        reach = [x for x in same if (x[1] >= r["v"] if descending else x[1] <= r["v"])]
        later = [x[1] for x in same if (x[1] < r["v"] if descending else x[1] > r["v"])]
        assert r["cum_n"] == sum(x[2] for x in reach)
        assert r["nxt"] == ((max if descending else min)(later) if later else None)


def test_global_index(spark):
    rng = random.Random(4)
    rows = sorted({(rng.randint(0, 20), rng.randint(0, 1000)) for _ in range(300)})
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = ordered.global_index(df, F.col("a"), [F.asc("a"), F.asc("b")], "i", 4).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.i)] == rows
    assert sorted(r.i for r in got) == list(range(len(rows)))


@pytest.mark.parametrize("slice_rows", [1, 5, 10**6])
def test_attach_by_key_with_hot_and_missing_keys(spark, slice_rows):
    keys = [1] * 300 + [2] * 4 + [None] * 50 + list(range(10, 60))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    out = attach_by_key(rows, keyed, "k", "n", slice_rows).collect()
    assert sorted(r.i for r in out) == list(range(len(keys)))
    assert all(r.first == keys.index(r.k) for r in out)


def test_empty_column_leaves_the_margin_of_others(spark, monkeypatch):
    """One column without values in one set must not widen the search of the rest."""
    df = spark.range(20_000).selectExpr("id % 2 as s", "cast(id * 37 % 9973 as double) as v", "if(id % 2 = 0, 1.0, null) as w")
    sets = {"a": F.col("s") == 0, "b": F.col("s") == 1}
    seen = []
    narrowed = ordered._narrowed
    monkeypatch.setattr(ordered, "_narrowed", lambda b, below, n, grid, m: seen.append(m) or narrowed(b, below, n, grid, m))
    found = ordered.exact_quantiles(df, ["v", "w"], [0.5], sets)
    assert found["b", "w"] == [None] and found["a", "w"] == [1.0]
    assert seen and max(seen) < 20


def test_wide_brackets_have_many_ranges(spark, monkeypatch):
    df = spark.range(5_000).selectExpr("cast(id as double) as v")
    cuts = []
    long_values = ordered.long_values
    monkeypatch.setattr(ordered, "long_values", lambda d, c, at, keep=(): cuts.append(at) or long_values(d, c, at, keep))
    monkeypatch.setattr(ordered, "MARGINS", (ordered.GRID,))
    assert ordered.exact_quantiles(df, ["v"], [0.5])["all", "v"] == [2499.5]
    assert len(cuts[0]["v"]) > 100
