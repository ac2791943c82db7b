"""Additive attributions of a score's log-odds to features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.operators.keyed import attach_by_key
from riskframe.operators.model import FittedModel
from riskframe.operators.prep import sparse_parts
from riskframe.session import materialize, new_shared_path

#: Bytes of a node, and of the trees that are sent to every task.
NODE_BYTES, MAX_BYTES = 56, 64 << 20
TOP_FEATURES = 15
TOP_LOCAL = 10
TOP_REASONS = 5

# Wording of a reason's direction.
RAISES = "augmente"
LOWERS = "diminue"


# --- linear scores over plain columns ----------------------------------------


def linear_margin(coefs: Mapping[str, float], intercept: float = 0.0) -> Column:
    terms = [F.lit(w) * F.col(c) for c, w in coefs.items()]
    return reduce(lambda a, t: a + t, terms, F.lit(float(intercept)))


def logistic(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def linear_contributions(df: DataFrame, coefs: Mapping[str, float], means: Mapping[str, float], prefix="contrib_"):
    """Add one column per feature: coefficient times distance from the mean."""
    return df.select(
        "*", *[(F.lit(w) * (F.col(c) - F.lit(means[c]))).alias(prefix + c) for c, w in coefs.items()]
    )


def long_contributions(df: DataFrame, key: str, features: Sequence[str], prefix="contrib_") -> DataFrame:
    """(key, feature, value, contribution) rows from contribution columns."""
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).cast("double").alias("value"),
            F.col(prefix + c).alias("contribution"),
        )
        for c in features
    ]
    return df.select(key, F.explode(F.array(*cells)).alias("cell")).select(key, "cell.*")


def column_importance(df: DataFrame, features: Sequence[str], top: int = TOP_FEATURES, prefix="contrib_") -> DataFrame:
    """Mean absolute contribution per feature: one aggregate row, then sorted."""
    return (
        df.agg(*[F.avg(F.abs(F.col(prefix + c))).alias(c) for c in features])
        .unpivot([], list(features), "feature", "importance")
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )


def effect_detail(long: DataFrame, importance: DataFrame) -> DataFrame:
    """Value and contribution rows of the most important features."""
    return long.join(F.broadcast(importance.select("feature")), "feature", "left_semi")  # at most top-k rows


def highest_risk(df: DataFrame, prob: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(prob), F.asc(key)).limit(1)


def largest_contributions(long: DataFrame, top: int = TOP_LOCAL) -> DataFrame:
    return long.orderBy(F.desc(F.abs("contribution")), "feature").limit(top)


def reason(feature: Column, contribution: Column, digits: int = 4) -> Column:
    return F.struct(
        feature.alias("feature"),
        F.round(contribution, digits).alias("contribution"),
        F.when(contribution > 0, RAISES).otherwise(LOWERS).alias("direction"),
    )


def column_reasons(features: Sequence[str], top: int = TOP_REASONS, prefix="contrib_") -> Column:
    """The row's largest contributions as an array of reasons; no shuffle."""
    cells = [
        F.struct(
            (-F.abs(F.col(prefix + c))).alias("rank"), F.lit(c).alias("feature"), F.col(prefix + c).alias("contribution")
        )
        for c in features
    ]
    ordered = F.slice(F.array_sort(F.array(*cells)), 1, top)
    return F.transform(ordered, lambda x: reason(x["feature"], x["contribution"]))


# --- fitted models -----------------------------------------------------------


class PackedTrees:
    """Trees as arrays, for the Shapley values of a whole batch of rows.

    A leaf's game over the features of its path is a product: feature j gives 1
    or 0 when it is known, and its share of training rows when it is not. Its
    Shapley values are integrals over t in [0, 1] of products of
    share + (met - share) t; they are polynomials, so Gauss-Legendre points give
    them exactly. The products are carried down the tree and the leaves' values
    back up, each edge is visited once, and rows that meet the same conditions
    are computed once.
    """

    def __init__(self, tree, feature, cut, left, right, value, rows):
        # Nodes of one tree follow each other, children after parents; left and right are places, -1 in leaves.
        self.tree, self.feature, self.cut = tree, feature, cut
        self.left, self.right, self.value, self.rows = left, right, value, rows
        self._made = None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}  # tasks make their own tables

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.tree, self.feature, self.cut, self.left, self.right, self.value, self.rows))

    def _paths(self):
        """Per node: parent, depth, feature of the edge to it, interval and share of that
        feature on the whole path, and the nearest edge above of the same feature."""
        n = len(self.tree)
        parent, depth, edge, above = (np.full(n, -1) for _ in range(4))
        low, high, share = np.full(n, -np.inf), np.full(n, np.inf), np.ones(n)
        inner = np.flatnonzero(self.left >= 0)
        parent[self.left[inner]] = parent[self.right[inner]] = inner
        for i in range(n):
            p = parent[i]
            if p < 0:
                depth[i] = 0
                continue
            depth[i], edge[i] = depth[p] + 1, self.feature[p]
            share[i] = self.rows[i] / self.rows[p]
            over = p
            while over >= 0 and edge[over] != edge[i]:
                over = parent[over]
            if over >= 0:
                above[i], low[i], high[i] = over, low[over], high[over]
                share[i] *= share[over]
            if i == self.left[p]:
                high[i] = min(high[i], self.cut[p])
            else:
                low[i] = max(low[i], self.cut[p])
        return parent, depth, edge, above, low, high, share

    def _tables(self):
        if self._made is None:
            parent, depth, edge, above, low, high, share = self._paths()
            at, weight = np.polynomial.legendre.leggauss(max(1, (int(depth.max(initial=0)) + 2) // 2))
            t, weight = (at + 1) / 2, weight / 2
            met, missed = share[:, None] + (1 - share)[:, None] * t, share[:, None] * (1 - t)
            # Slopes: (met - share) over the factor.
            met_slope, missed_slope = (1 - share)[:, None] / met, np.broadcast_to(-1 / (1 - t), missed.shape)
            self._made = parent, depth, edge, above, low, high, met, missed, met_slope, missed_slope, weight
        return self._made

    def base(self) -> float:
        """The log-odds expected when nothing is known."""
        roots = np.flatnonzero(np.append(True, self.tree[1:] != self.tree[:-1])) if len(self.tree) else []
        reach = np.zeros(len(self.tree))
        reach[roots] = 1.0
        for i in np.flatnonzero(self.left >= 0):
            for child in (self.left[i], self.right[i]):
                reach[child] = reach[i] * self.rows[child] / self.rows[i]
        return float((reach * self.value)[self.left < 0].sum())

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Per row the place of every asked feature's value among its cuts: rows of equal places get equal values."""
        inner = self.left >= 0
        asked = np.unique(self.feature[inner])
        out = np.empty((len(x), len(asked)), dtype="<i4")
        for k, f in enumerate(asked):
            out[:, k] = np.searchsorted(np.unique(self.cut[inner & (self.feature == f)]), x[:, f], side="left")
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        if not len(x) or not len(self.tree):
            return out
        ends = np.flatnonzero(np.append(self.tree[1:] != self.tree[:-1], True)) + 1
        for first, last in zip(np.concatenate([[0], ends[:-1]]), ends):
            if last - first > 1:
                self._add_tree(out, x, first, last)
        return out

    def _add_tree(self, out: np.ndarray, x: np.ndarray, first: int, last: int) -> None:
        parent, depth, edge, above, low, high, met, missed, met_slope, missed_slope, weight = (
            t[first:last] if len(t) == len(self.tree) else t for t in self._tables()
        )
        on = (x[:, edge] > low) & (x[:, edge] <= high)
        on[:, 0] = True  # the root has no condition
        _, kept, place = np.unique(np.packbits(on, axis=1), axis=0, return_index=True, return_inverse=True)
        on = on[kept].T
        has = above >= 0
        over = np.where(has, above - first, 0)
        product = np.ones((last - first, on.shape[1], len(weight)))
        levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)]
        factor = np.where(on[..., None], met[:, None, :], missed[:, None, :])
        for ids in levels:
            again = np.where(has[ids, None, None], factor[over[ids]], 1.0)
            product[ids] = product[parent[ids] - first] * factor[ids] / again
        left, right = self.left[first:last] - first, self.right[first:last] - first
        leaf = left < 0
        product[leaf] *= self.value[first:last][leaf, None, None]
        for ids in [np.array([0]), *levels][::-1]:
            inner = ids[~leaf[ids]]
            product[inner] = product[left[inner]] + product[right[inner]]
        slope = np.where(on[..., None], met_slope[:, None, :], missed_slope[:, None, :])
        slope = slope - np.where(has[:, None, None], slope[over], 0.0)
        amount = np.einsum("nuq,q->nu", product * slope, weight)[1:]
        features, number = np.unique(edge[1:], return_inverse=True)
        totals = np.zeros((len(features), amount.shape[1]))
        np.add.at(totals, number, amount)
        out[:, features] += totals.T[place.reshape(-1)]


@dataclass(frozen=True)
class Explainer:
    """What a task needs to attribute a batch of encoded rows."""

    names: list[str]
    base: float
    coefs: np.ndarray | None = None
    means: np.ndarray | None = None
    trees: PackedTrees | None = None

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Rows by features; each row adds up to its log-odds minus the base."""
        if self.coefs is not None:
            return (x - self.means) * self.coefs
        return np.zeros_like(x) if self.trees is None else self.trees.contributions(x)


def tree_nodes(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    """The node table of a fitted booster, read from its saved form."""
    path = new_shared_path(spark, "trees")
    model.write().save(path)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.rawCount").alias("rows"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("bound"),
        (F.col("nodeData.split.numCategories") > 0).alias("one_hot"),
    )


def packed_trees(nodes: DataFrame, weights: Sequence[float]) -> PackedTrees:
    """The node table as arrays in log-odds, after a check of its size."""
    if nodes.count() * NODE_BYTES > MAX_BYTES:
        raise ValueError("the booster has too many nodes to send to every task")
    table = nodes.orderBy("tree", "node").toPandas()
    tree, node = table["tree"].to_numpy(), table["node"].to_numpy()
    starts = np.searchsorted(tree, np.arange(len(weights)))
    left, right = (np.where(table[c] < 0, -1, table[c] + starts[tree]) for c in ("left", "right"))
    cut, one_hot = table["bound"].to_numpy(float), table["one_hot"].to_numpy(bool)
    # A split on 0 and 1 names the value that goes left.
    swap = one_hot & (cut != 0.0)
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    value = 2.0 * np.asarray(weights)[tree] * table["prediction"].to_numpy()
    assert (node == np.arange(len(tree)) - starts[tree]).all()
    return PackedTrees(
        tree, table["feature"].to_numpy(), np.where(one_hot, 0.5, cut), left, right, value, table["rows"].to_numpy(float)
    )


def explainer(model: FittedModel, background: DataFrame | None = None) -> Explainer:
    """Explainer of a fitted model; a linear one needs its training rows."""
    clf = model.classifier
    if isinstance(clf, LogisticRegressionModel):
        if background is None:
            raise ValueError("a linear model is explained against the means of its training rows")
        means = model.encoder.transform(background).select(Summarizer.mean(F.col("features"))).first()[0].toArray()
        coefs = clf.coefficients.toArray()
        return Explainer(model.names, float(clf.intercept + means @ coefs), coefs, means)
    trees = packed_trees(tree_nodes(SparkSession.active(), clf), clf.treeWeights)
    return Explainer(model.names, trees.base(), trees=trees)


def dense_rows(width: int, indices: pd.Series, values: pd.Series) -> np.ndarray:
    """A batch of sparse rows as a matrix."""
    out = np.zeros((len(indices), width))
    if len(indices):
        rows = np.repeat(np.arange(len(indices)), [len(i) for i in indices])
        out[rows, np.concatenate(indices.to_list()).astype(int)] = np.concatenate(values.to_list())
    return out


BATCH_CELLS = 4_000_000


def batches(width: int, n: int):
    """Row ranges whose dense form stays small whatever the vector's width."""
    step = max(1, BATCH_CELLS // max(width, 1))
    return [slice(i, min(i + step, n)) for i in range(0, n, step)]


def encoded(df: DataFrame, model: FittedModel, keep: Sequence[str]) -> DataFrame:
    _, indices, values = sparse_parts()
    return model.encoder.transform(df).select(*keep, indices.alias("_indices"), values.alias("_values"))


def _with_kind(rows: DataFrame, explain: Explainer) -> DataFrame:
    """Encoded rows with a key that is equal only for rows of equal contributions, written."""
    width = len(explain.names)

    @F.pandas_udf("binary")
    def kind(indices: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for at in batches(width, len(indices)):
            out += [c.tobytes() for c in explain.trees.cells(dense_rows(width, indices.iloc[at], values.iloc[at]))]
        return pd.Series(out, dtype=object)

    return materialize(rows.withColumn("_kind", kind("_indices", "_values")), "kinds")


def _kinds(rows: DataFrame) -> DataFrame:
    """(_kind, n, _indices, _values): one row of every kind, and the number of its rows."""
    one = F.min_by(F.struct("_indices", "_values"), F.xxhash64("_indices", "_values")).alias("row")
    kinds = rows.groupBy("_kind").agg(F.count(F.lit(1)).alias("n"), one).select("_kind", "n", "row.*")
    # Neighbouring kinds meet the same conditions of many trees.
    return kinds.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, "_kind")


def _by_kind(rows: DataFrame, explain: Explainer) -> DataFrame:
    """(_kind, n, slots, amounts): contributions of one row of every kind, and the number of its rows."""
    width = len(explain.names)

    def run(parts):
        for pdf in parts:
            for at in batches(width, len(pdf)):
                phi = explain.contributions(dense_rows(width, pdf["_indices"].iloc[at], pdf["_values"].iloc[at]))
                slots = [np.flatnonzero(p) for p in phi]
                yield pd.DataFrame(
                    {"_kind": pdf["_kind"].iloc[at].to_numpy(), "n": pdf["n"].iloc[at].to_numpy(), "slots": slots,
                     "amounts": [p[c] for p, c in zip(phi, slots)]}
                )

    found = _kinds(rows).mapInPandas(run, "_kind binary, n bigint, slots array<int>, amounts array<double>")
    return materialize(found, "contributions")


def model_contributions(df: DataFrame, model: FittedModel, explain: Explainer, key: str) -> DataFrame:
    """(key, feature, value, contribution); features that add nothing are left out.

    Rows that a booster cannot tell apart are attributed once.
    """
    names, width = np.array(explain.names, dtype=object), len(explain.names)
    if explain.trees is not None and len(explain.trees.tree):
        rows = _with_kind(encoded(df, model, [key]), explain)
        cell = F.explode(F.arrays_zip("slots", "amounts")).alias("c")
        both = attach_by_key(rows, _by_kind(rows, explain), "_kind").select(key, "_indices", "_values", cell)
        at = F.array_position("_indices", F.col("c.slots")).cast("int") - 1
        named = F.lit(list(explain.names))
        return both.select(
            key,
            F.get(named, F.col("c.slots")).alias("feature"),
            F.coalesce(F.when(at >= 0, F.get("_values", at)), F.lit(0.0)).alias("value"),
            F.col("c.amounts").alias("contribution"),
        )

    def run(parts):
        for pdf in parts:
            for at in batches(width, len(pdf)):
                x = dense_rows(width, pdf["_indices"].iloc[at], pdf["_values"].iloc[at])
                phi = explain.contributions(x)
                r, c = np.nonzero(phi)
                yield pd.DataFrame(
                    {
                        key: pdf[key].iloc[at].to_numpy()[r],
                        "feature": names[c],
                        "value": x[r, c],
                        "contribution": phi[r, c],
                    }
                )

    key_type = df.schema[key].dataType.simpleString()
    return encoded(df, model, [key]).mapInPandas(
        run, f"`{key}` {key_type}, feature string, value double, contribution double"
    )


def model_importance(df: DataFrame, model: FittedModel, explain: Explainer, top: int = TOP_FEATURES) -> DataFrame:
    """Mean absolute contribution; each task adds up its rows before the shuffle."""
    width = len(explain.names)

    def run(parts):
        total, n = np.zeros(width), 0
        for pdf in parts:
            for at in batches(width, len(pdf)):
                x = dense_rows(width, pdf["_indices"].iloc[at], pdf["_values"].iloc[at])
                times = pdf["n"].iloc[at].to_numpy()
                total += times @ np.abs(explain.contributions(x))
                n += int(times.sum())
        if n:
            yield pd.DataFrame({"feature": explain.names, "total": total, "n": n})

    rows = encoded(df, model, []).withColumn("n", F.lit(1).cast("bigint"))
    if explain.trees is not None and len(explain.trees.tree):
        found = _by_kind(_with_kind(rows.drop("n"), explain), explain)
        cells = found.select("n", F.explode(F.arrays_zip("slots", "amounts")).alias("c"))
        sums = cells.groupBy(F.col("c.slots").alias("slot")).agg(F.sum(F.abs("c.amounts") * F.col("n")).alias("total"))
        every = df.sparkSession.createDataFrame(list(enumerate(explain.names)), "slot int, feature string")
        size = found.agg(F.sum("n").alias("n"))  # one row
        added = every.join(sums, "slot", "left").crossJoin(F.broadcast(size)).where("n > 0")
        totals = added.select("feature", F.coalesce("total", F.lit(0.0)).alias("total"), "n")
    else:
        totals = rows.mapInPandas(run, "feature string, total double, n bigint")
    return (
        totals.groupBy("feature")
        .agg((F.sum("total") / F.sum("n")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
        .limit(top)
    )


def reasons_udf(explain: Explainer, top: int = TOP_REASONS):
    """Arrow-batched function (indices, values) -> largest contributions."""
    names, width = np.array(explain.names, dtype=object), len(explain.names)

    @F.pandas_udf("feature array<string>, contribution array<double>")
    def run(indices: pd.Series, values: pd.Series) -> pd.DataFrame:
        features, amounts = [], []
        for at in batches(width, len(indices)):
            phi = explain.contributions(dense_rows(width, indices.iloc[at], values.iloc[at]))
            order = np.argsort(-np.abs(phi), axis=1, kind="stable")[:, :top]
            features += [list(names[o]) for o in order]
            amounts += [list(row) for row in np.take_along_axis(phi, order, axis=1)]
        return pd.DataFrame({"feature": features, "contribution": amounts})

    return run


def reasons_column(explain: Explainer, top: int = TOP_REASONS) -> Column:
    """Reasons of an encoded row (needs its ``features`` column)."""
    _, indices, values = sparse_parts()
    found = reasons_udf(explain, top)(indices, values)
    return F.zip_with(found["feature"], found["contribution"], lambda f, c: reason(f, c))


def with_reasons(df: DataFrame, explain: Explainer, name: str, top: int = TOP_REASONS) -> DataFrame:
    """Add the reasons of encoded rows (needs ``features``); a table's rows that a booster cannot tell apart share one's."""
    if df.isStreaming or explain.trees is None or not len(explain.trees.tree):
        return df.withColumn(name, reasons_column(explain, top))
    _, indices, values = sparse_parts()
    rows = _with_kind(df.withColumns({"_indices": indices, "_values": values}).drop("features"), explain)
    found = reasons_udf(explain, top)("_indices", "_values")
    kinds = _kinds(rows).select("_kind", "n", found.alias("f"))
    listed = F.zip_with("f.feature", "f.contribution", lambda f, c: reason(f, c)).alias(name)
    known = materialize(kinds.select("_kind", "n", listed), "reasons")
    return attach_by_key(rows, known, "_kind").drop("_kind", "_indices", "_values")
