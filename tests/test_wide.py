import numpy as np
import pytest

from riskframe.operators import model, prep, wide
from tests.data import signal

SPEC = prep.FeatureSpec(["num1"], ["cat1"])


def cells_of(spark, table):
    """The encoder's non-zero entries as (row_id, feature, value)."""
    from pyspark.sql import functions as F

    fitted = model.fit_model(table, SPEC, "y", model.logistic_learner())
    _, indices, values = prep.sparse_parts()
    names = F.array(*[F.lit(n) for n in fitted.names])
    cell = F.explode(F.arrays_zip(indices.alias("i"), values.alias("v"))).alias("c")
    rows = fitted.encoder.transform(table).select("row_id", cell)
    return fitted, rows.select("row_id", names[F.col("c.i")].alias("feature"), F.col("c.v").alias("value"))


def test_coefficients_equal_the_vector_model(spark):
    table = signal(spark, 150)
    fitted, cells = cells_of(spark, table)
    found = wide.fit_wide(cells, table.select("row_id", "y"), "row_id", "y")
    coefs = {r.feature: r.coef for r in found.table.collect()}
    want = dict(zip(fitted.names, fitted.classifier.coefficients.toArray()))
    assert set(coefs) == set(want) and found.iterations < 60
    assert all(abs(coefs[n] - want[n]) < 2e-3 for n in want)
    assert abs(found.intercept - fitted.classifier.intercept) < 2e-3
    # Scores agree, also where a key has no cell or an unseen one.
    extra = spark.createDataFrame([(-1, "never seen", 3.0)], cells.schema)
    keys = table.select("row_id").unionByName(spark.createDataFrame([(-1,), (-2,)], "row_id long"))
    got = {r.row_id: r.p for r in wide.score_wide(cells.unionByName(extra), keys, "row_id", found).collect()}
    known = {r.row_id: r.p for r in model.score(table, fitted).select("row_id", "p").collect()}
    assert all(abs(got[i] - p) < 1e-3 for i, p in known.items())
    assert got[-1] == got[-2] == pytest.approx(1 / (1 + np.exp(-found.intercept)))
    with pytest.raises(ValueError):
        wide.fit_wide(cells, table.where("y = 0").select("row_id", "y"), "row_id", "y")


def test_rows_are_not_written_again_in_each_step(spark, monkeypatch):
    written, write = [], wide.materialize
    monkeypatch.setattr(wide, "materialize", lambda df, name: written.append((name, df.columns)) or write(df, name))
    table = signal(spark, 150)
    _, cells = cells_of(spark, table)
    found = wide.fit_wide(cells, table.select("row_id", "y"), "row_id", "y", max_iter=4)
    assert found.iterations == 4
    assert sum("key" in columns for _, columns in written) <= 2  # the cells and the packed rows


@pytest.mark.parametrize("common", [0.5, 3])
def test_common_and_other_features_fit_the_same(spark, monkeypatch, common):
    table = signal(spark, 60)
    _, cells = cells_of(spark, table)
    labels = table.select("row_id", "y").unionByName(spark.createDataFrame([(-1, 1)], "row_id long, y int"))  # without cells
    fit = lambda: wide.fit_wide(cells, labels, "row_id", "y", max_iter=6)
    whole = fit()
    monkeypatch.setattr(wide, "COMMON", common)  # no feature is common, or some
    other = fit()
    assert whole.iterations == other.iterations == 6
    assert whole.intercept == pytest.approx(other.intercept) and whole.n_rows == other.n_rows
    want, got = ({r.feature: (r.coef, r.gradient, r.n) for r in m.table.collect()} for m in (whole, other))
    assert set(want) == set(got) and all(got[f] == pytest.approx(want[f], abs=1e-6) for f in want)


def test_direction_is_the_two_loop_recursion():
    rng = np.random.default_rng(0)
    size, kept = 12, 4
    a = rng.normal(size=(size, size))
    curve = a @ a.T + np.eye(size)
    s = rng.normal(size=(kept, size))
    y = s @ curve
    g = rng.normal(size=size)
    q, alphas = g.copy(), []
    for i in reversed(range(kept)):
        alphas.append(s[i] @ q / (s[i] @ y[i]))
        q -= alphas[-1] * y[i]
    q *= s[-1] @ y[-1] / (y[-1] @ y[-1])
    for i, alpha in zip(range(kept), reversed(alphas)):
        q += (alpha - y[i] @ q / (s[i] @ y[i])) * s[i]
    basis = np.vstack([g, s, y])
    assert np.allclose(wide._direction(basis @ basis.T, kept) @ basis, -q)
