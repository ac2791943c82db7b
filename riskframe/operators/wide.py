"""Logistic regression with more coefficients than a task can hold.

Coefficients are a table keyed by feature. The cells of common features (a share
of all cells that fewer than ``COMMON`` features can have) stand packed beside
their rows, and these coefficients go to the tasks: their margins and gradients
take one pass over the rows, without a shuffle. Margins of all other cells come
from a join with the table, their gradient from a join with the rows' errors; no
vocabulary is collected beyond the common features. The steps are L-BFGS in its
vector-free form: all inner products of the gradient and the kept steps come
from one aggregate over the table, so the driver handles a few dozen numbers, and
the next direction is an expression over the table's columns. A full step is
tried with its gradient in the same pass; only where it fails are shorter ones
searched, by one aggregate, since margins change linearly along the direction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskframe.operators.keyed import SLICE_ROWS, attach_by_key
from riskframe.session import materialize

#: A feature with more than 1/COMMON of all cells is packed beside the rows.
COMMON = 4_096
#: Slot of the constant cell that every row has.
CONSTANT = -1
#: Kept steps, and step lengths that are tried at once.
MEMORY = 5
STEPS = [2.0**-i for i in range(14)]


@dataclass(frozen=True)
class WideModel:
    """feature, coef, gradient of the penalised loss, cells; the intercept and its gradient; rows."""

    table: DataFrame
    intercept: float
    intercept_gradient: float
    n_rows: int
    iterations: int


def _losses(margin: Column) -> Column:
    """Weighted loss of a row whose label is y."""
    safe = F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
    return F.col("weight") * (safe - F.col("y") * margin)


def _error(margin: Column) -> Column:
    return F.col("weight") * (1 / (1 + F.exp(-margin)) - F.col("y"))


def _direction(dots: np.ndarray, kept: int) -> np.ndarray:
    """The two-loop recursion on inner products: the direction's share of each column [g, s.., y..]."""
    share = np.zeros(1 + 2 * kept)
    share[0] = -1.0
    alphas = np.zeros(kept)
    for i in reversed(range(kept)):
        s, y = 1 + i, 1 + kept + i
        alphas[i] = dots[s] @ share / dots[s, y]
        share[y] -= alphas[i]
    share *= dots[kept, 2 * kept] / dots[2 * kept, 2 * kept] if kept else 1 / max(np.sqrt(dots[0, 0]), 1e-300)
    for i in range(kept):
        s, y = 1 + i, 1 + kept + i
        share[s] += alphas[i] - dots[y] @ share / dots[s, y]
    return share


def fit_wide(
    cells: DataFrame,
    labels: DataFrame,
    key: str,
    label: str,
    strength: float = 1.0,
    max_iter: int = 100,
    tolerance: float = 1e-6,
) -> WideModel:
    """Balanced regression with an L2 penalty over (key, feature, value) cells and (key, label) rows.

    Rows without cells count through the intercept. Each step's tables are
    written, so a lost executor costs one step.
    """
    spark = cells.sparkSession
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")
    cells = materialize(cells.where("feature is not null").select(F.col(key).alias("key"), "feature", value), "cells")
    y = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"))
    n0, n1 = y.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    if not n0 or not n1:
        raise ValueError("training rows hold one class only")
    n, penalty = n0 + n1, 1 / strength
    weight = F.when(F.col("y") == 1, n / (2 * n1)).otherwise(n / (2 * n0))
    used = cells.join(y.select("key"), "key", "left_semi")
    counts = materialize(used.groupBy("feature").agg(F.count(F.lit(1)).alias("n")), "features")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") > total / COMMON).orderBy("feature").collect()  # fewer than COMMON rows
    slots = T.StructType([T.StructField("slot", T.IntegerType()), counts.schema["feature"]])
    slots = F.broadcast(spark.createDataFrame([(i, r["feature"]) for i, r in enumerate(common)], slots))
    packed = used.join(slots, "feature").groupBy("key").agg(F.collect_list(F.struct("slot", "value")).alias("cells"))
    none = F.array().cast("array<struct<slot:int,value:double>>")
    rows = y.select("key", "y", weight.alias("weight")).join(packed, "key", "left")
    rows = materialize(rows.withColumn("cells", F.coalesce("cells", none)), "rows")
    # Cells of a frequent feature are dealt over slices once; its coefficient goes to each of them.
    counts = counts.withColumn("slices", F.ceil(F.col("n") / SLICE_ROWS).cast("int")).join(slots, "feature", "left")
    rest = None
    if sum(r["n"] for r in common) < total:
        several = counts.where("slices > 1 and slot is null").select("feature", "slices")  # at most cells / SLICE_ROWS features
        dealt = F.coalesce(F.pmod(F.xxhash64("key"), F.col("slices")), F.lit(0)).cast("int")
        rest = used.join(slots, "feature", "left_anti").join(several, "feature", "left")
        rest = materialize(rest.withColumn("slice", dealt).drop("slices"), "rest")

    def dot(coefs: np.ndarray) -> Column:
        """The common cells' part of the margin."""
        if not len(coefs):
            return F.lit(0.0)
        listed = F.expr(f"array({', '.join(f'{float(v)!r}D' for v in coefs)})")
        return F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["value"] * F.get(listed, c["slot"]))

    def placed(margin: Column, far: DataFrame | None) -> DataFrame:
        """The rows with their margin; ``far`` holds the other cells' part."""
        with_far = rows if far is None else rows.join(far, "key", "left").fillna(0.0, ["far"])
        return with_far.select("key", "y", "weight", "cells", (margin if far is None else margin + F.col("far")).alias("m"))

    def pulls(at: DataFrame) -> tuple[float, float, DataFrame]:
        """The loss, the intercept's and all features' part of the gradient."""
        constant = F.array(F.struct(F.lit(CONSTANT).alias("slot"), F.lit(1.0).alias("value")))
        each = at.select(_losses(F.col("m")).alias("loss"), _error(F.col("m")).alias("r"), "cells")
        each = each.select("loss", "r", F.explode(F.concat(constant, "cells")).alias("c"))
        sums = F.sum(F.col("r") * F.col("c.value")).alias("pull"), F.sum("loss").alias("loss")
        found = {r["slot"]: r for r in each.groupBy("c.slot").agg(*sums).collect()}  # at most COMMON rows
        own = [(r["feature"], found[i]["pull"]) for i, r in enumerate(common)]
        out = spark.createDataFrame(own, T.StructType([counts.schema["feature"], T.StructField("pull", T.DoubleType())]))
        if rest is not None:
            errors = at.select("key", _error(F.col("m")).alias("r"))
            far = rest.join(errors, "key").groupBy("feature").agg(F.sum(F.col("value") * F.col("r")).alias("pull"))
            out = out.unionByName(far)
        return found[CONSTANT]["loss"], found[CONSTANT]["pull"], out

    w, b, far = np.zeros(len(common)), 0.0, None
    loss, gb, found = pulls(placed(F.lit(0.0), None))
    table = counts.join(found, "feature").select("feature", "slices", "slot", F.lit(0.0).alias("w"), F.col("pull").alias("g"))
    table = materialize(table, "coefficients")
    history: list[tuple[float, float]] = []  # the intercept's parts of the kept steps
    done = 0
    while done < max_iter:
        kept = len(history)
        columns = ["g", *[f"s{i}" for i in range(kept)], *[f"y{i}" for i in range(kept)]]
        own = np.array([gb, *[s for s, _ in history], *[v for _, v in history]])
        size = len(columns)
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        sums = [F.expr(f"sum({columns[i]} * {columns[j]})") for i, j in pairs]
        sums += [F.expr(f"sum(w * {c})") for c in columns] + [F.expr("sum(w * w)"), F.expr("max(abs(g))")]
        found = [v or 0.0 for v in table.agg(*sums).first()]  # one row
        if max(found[-1], abs(gb)) / n < tolerance:
            break
        dots = np.zeros((size, size))
        for (i, j), v in zip(pairs, found):
            dots[i, j] = dots[j, i] = v
        w_dots, ww = np.array(found[len(pairs) : len(pairs) + size]), found[-2]
        share = _direction(dots + np.outer(own, own), kept)
        db = float(share @ own)
        slope = float(share @ (dots[0] + own[0] * own))
        dd, wd = float(share @ dots @ share), float(share @ w_dots)
        step = F.expr(" + ".join(f"{float(v)!r}D * {c}" for v, c in zip(share, columns)))
        d = np.zeros(len(common))
        for r in table.where("slot is not null").select("slot", step.alias("d")).collect():  # fewer than COMMON rows
            d[r["slot"]] = r["d"]
        if rest is not None:
            slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
            moved = rest.join(table.where("slot is null").select("feature", step.alias("d"), slices), ["feature", "slice"])
            moved = moved.groupBy("key").agg(F.sum(F.col("value") * F.col("d")).alias("md"))
            before = moved.withColumn("m", F.lit(0.0)) if far is None else moved.join(far, "key")  # always the same keys
            moved = materialize(before, "margins")

        def at(t: float) -> DataFrame:
            far = None if rest is None else moved.select("key", (F.col("m") + F.lit(t) * F.col("md")).alias("far"))
            return placed(dot(w + t * d) + F.lit(b + t * db), far)

        def short_enough(t: float, loss_there: float) -> bool:
            there = loss_there + penalty / 2 * (ww + 2 * t * wd + t * t * dd)
            return there <= loss + penalty / 2 * ww + 1e-4 * t * slope

        t = STEPS[0]
        new = pulls(at(t))
        if not short_enough(t, new[0]):
            along = at(0.0).withColumn("md", dot(d) + F.lit(db))
            if rest is not None:
                along = along.join(moved.select("key", F.col("md").alias("far")), "key", "left").fillna(0.0, ["far"])
                along = along.withColumn("md", F.col("md") + F.col("far"))
            tried = along.agg(*[F.sum(_losses(F.col("m") + F.lit(s) * F.col("md"))) for s in STEPS[1:]]).first()
            good = [s for s, f in zip(STEPS[1:], tried) if short_enough(s, f)]
            if not good:
                break
            t = good[0]
            new = pulls(at(t))
        loss, new_gb, found = new
        if rest is not None:
            far = moved.select("key", (F.col("m") + F.lit(t) * F.col("md")).alias("m"))
        first = max(0, kept + 1 - MEMORY)
        to = F.col("w") + F.lit(t) * step
        g = F.coalesce("pull", F.lit(0.0)) + F.lit(penalty) * to
        s = [F.col(f"s{i}") for i in range(first, kept)] + [F.lit(t) * step]
        v = [F.col(f"y{i}") for i in range(first, kept)] + [g - F.col("g")]
        named = [c.alias(f"s{i}") for i, c in enumerate(s)] + [c.alias(f"y{i}") for i, c in enumerate(v)]
        table = table.join(found, "feature", "left").select("feature", "slices", "slot", to.alias("w"), g.alias("g"), *named)
        table = materialize(table, "coefficients")
        history = [*history, (t * db, new_gb - gb)][-MEMORY:]
        w, b, gb, done = w + t * d, b + t * db, new_gb, done + 1
    found = table.select("feature", F.col("w").alias("coef"), F.col("g").alias("gradient"))
    return WideModel(found.join(counts.select("feature", "n"), "feature"), b, gb, n, done)


def score_wide(cells: DataFrame, keys: DataFrame, key: str, model: WideModel, out: str = "p") -> DataFrame:
    """P(y=1) of every key; cells of features the model has not seen add nothing."""
    known = attach_by_key(cells.select(key, "feature", "value"), materialize(model.table.drop("gradient"), "coefs"), "feature")
    margins = known.groupBy(key).agg(F.sum(F.col("value") * F.col("coef")).alias("_margin"))
    margin = F.coalesce("_margin", F.lit(0.0)) + F.lit(model.intercept)
    return keys.join(margins, key, "left").select(*keys.columns, (1 / (1 + F.exp(-margin))).alias(out))
