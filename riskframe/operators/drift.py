"""Drift of a current table against a reference table, and the retrain rule.

Both tables are reduced to their levels (distinct values with the count on
each side) before anything is compared, so a level that holds a third of all
rows crosses the shuffle as one row per map task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskframe.functions.expressions import clipped, draw_int, draw_unit, next_level
from riskframe.operators.ordered import BUCKET, long_values, number_or_missing, range_cuts, running_totals

DRIFT_SHARE = 0.2  # share of drifted columns above which to retrain
DISTANCE_LIMIT = 0.1  # a distance at or above this is drift
P_VALUE_LIMIT = 0.05  # a p-value below this is drift
MIN_STD = 0.001
SMALL_ROWS = 1_000  # reference rows up to which tests are used, distances beyond
FEW_LEVELS = 5  # a numeric column with no more distinct values is compared by levels
EXACT_ROWS = 10_000  # larger side up to which the Kolmogorov-Smirnov tail is exact


# --- repeatable stress of a table -------------------------------------------


@dataclass(frozen=True)
class NumericStress:
    """Scale by ``1 + factor * intensity`` and add 0..add_max, within bounds."""

    column: str
    factor: float | None = None
    add_max: int | None = None
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class OrdinalStress:
    """Move a share of rows one level up in an ordered list."""

    column: str
    levels: Sequence[str]
    share: float


@dataclass(frozen=True)
class OverwriteStress:
    """Set a share of rows to a value, or to missing."""

    column: str
    value: str | None
    share: float


def stressed(rule, key: str, seed: int, intensity: float, dtype) -> Column:
    c = F.col(rule.column)
    salt = f"{seed}|{rule.column}"
    if isinstance(rule, NumericStress):
        out = c.cast("double")
        if rule.factor:
            out = out * (1 + rule.factor * intensity)
        if rule.add_max:
            out = out + draw_int(salt, rule.add_max + 1, key) * intensity
        return clipped(F.bround(out).cast("int"), rule.low, rule.high)
    hit = draw_unit(salt, key) < rule.share * intensity
    if isinstance(rule, OrdinalStress):
        return F.when(hit, next_level(c, rule.levels)).otherwise(c)
    return F.when(hit, F.lit(rule.value).cast(dtype)).otherwise(c)


def stress(df: DataFrame, key: str, rules: Sequence, seed: int = 0, intensity: float = 1.0) -> DataFrame:
    """Apply the rules whose column is present: one projection, no shuffle."""
    changed = {
        r.column: stressed(r, key, seed, intensity, df.schema[r.column].dataType)
        for r in rules
        if r.column in df.columns
    }
    return df.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns])


# --- levels on both sides ----------------------------------------------------


def both_sides(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    return reference.select(*columns, F.lit(0).alias("_side")).unionAll(
        current.select(*columns, F.lit(1).alias("_side"))
    )


def _side_counts() -> list[Column]:
    return [F.count_if(F.col("_side") == 0).alias("n_ref"), F.count_if(F.col("_side") == 1).alias("n_cur")]


def numeric_levels(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, value, range, n_ref, n_cur for all numeric columns."""
    rows = both_sides(reference, current, columns)
    cuts = range_cuts(rows, columns)
    return long_values(rows, columns, cuts, ["_side"]).groupBy("column_name", BUCKET, "value").agg(*_side_counts())


def category_levels(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, level, n_ref, n_cur for all categorical columns."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in columns]
    return (
        both_sides(reference, current, columns)
        .select("_side", F.explode(F.array(*cells)).alias("cell"))
        .select("_side", "cell.*")
        .where(F.col("level").isNotNull())
        .groupBy("column_name", "level")
        .agg(*_side_counts())
    )


def column_sizes(reference: DataFrame, current: DataFrame, numeric=(), categorical=()) -> DataFrame:
    """column_name, rows_ref, rows_cur, std_ref: one aggregate, a row per column."""
    rows = both_sides(reference, current, [*numeric, *categorical])
    values = {c: number_or_missing(c) for c in numeric} | {c: F.col(c) for c in categorical}
    on_ref, on_cur = F.col("_side") == 0, F.col("_side") == 1
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.when(on_ref, v)).alias("rows_ref"),
            F.count(F.when(on_cur, v)).alias("rows_cur"),
            (F.stddev_pop(F.when(on_ref, v)) if c in set(numeric) else F.lit(None).cast("double")).alias("std_ref"),
        )
        for c, v in values.items()
    ]
    return rows.agg(F.explode(F.array(*cells)).alias("size")).select("size.*")


def _share_terms() -> list[Column]:
    """Aggregates over levels: Jensen-Shannon, chi-square, homogeneity."""
    p, q = F.col("n_ref") / F.col("rows_ref"), F.col("n_cur") / F.col("rows_cur")
    mid = (p + q) / 2
    js = F.when(p > 0, p * F.log(p / mid)).otherwise(0.0) + F.when(q > 0, q * F.log(q / mid)).otherwise(0.0)
    expected = p * F.col("rows_cur")
    chi2 = F.when(expected > 0, (F.col("n_cur") - expected) * (F.col("n_cur") - expected) / expected).otherwise(
        F.lit(math.inf)
    )
    pooled = (F.col("n_ref") + F.col("n_cur")) / (F.col("rows_ref") + F.col("rows_cur"))
    scale = F.col("rows_ref") * F.col("rows_cur") / (F.col("rows_ref") + F.col("rows_cur"))
    return [
        F.count(F.lit(1)).alias("n_levels"),
        F.max("rows_ref").alias("rows_ref"),
        F.max("rows_cur").alias("rows_cur"),
        F.sum(js).alias("_js"),
        F.sum(chi2).alias("chi2"),
        F.sum((p - q) * (p - q) / pooled * scale).alias("homogeneity"),
    ]


def _js_distance(base: float) -> Column:
    return F.sqrt(F.greatest(F.col("_js"), F.lit(0.0)) / 2 / F.lit(math.log(base)))


def category_drift(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], base: float = math.e
) -> DataFrame:
    """Per column: levels, rows, js_distance, chi2, homogeneity."""
    sizes = column_sizes(reference, current, categorical=columns).drop("std_ref")
    levels = category_levels(reference, current, columns).join(F.broadcast(sizes), "column_name")
    out = levels.where((F.col("rows_ref") > 0) & (F.col("rows_cur") > 0)).groupBy("column_name").agg(*_share_terms())
    return out.withColumn("js_distance", _js_distance(base)).drop("_js")


def numeric_drift(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], base: float = math.e
) -> DataFrame:
    """Per column: levels, rows, wasserstein (in reference deviations), ks,
    and the shares-based statistics of its distinct values."""
    levels = numeric_levels(reference, current, columns)
    steps = running_totals(levels, "value", ["n_ref", "n_cur"], ["column_name"], next_value="_next", stored=True)
    sizes = column_sizes(reference, current, columns)
    gap = F.abs(F.col("cum_n_ref") / F.col("rows_ref") - F.col("cum_n_cur") / F.col("rows_cur"))
    moved = (
        steps.join(F.broadcast(sizes), "column_name")
        .where((F.col("rows_ref") > 0) & (F.col("rows_cur") > 0))
        .groupBy("column_name")
        .agg(
            F.sum(gap * (F.coalesce("_next", "value") - F.col("value"))).alias("_area"),
            F.max(gap).alias("ks"),
            F.max("std_ref").alias("std_ref"),
            *_share_terms(),
        )
    )
    return moved.select(
        "column_name",
        "n_levels",
        "rows_ref",
        "rows_cur",
        (F.col("_area") / F.greatest(F.coalesce("std_ref", F.lit(0.0)), F.lit(MIN_STD))).alias("wasserstein"),
        "ks",
        "chi2",
        "homogeneity",
        _js_distance(base).alias("js_distance"),
    )


# --- p-values, one per compared column ---------------------------------------


def _upper_tail(x: float, dof: int) -> float:
    """P(chi-square with dof degrees > x), by its finite sum."""
    if dof < 1 or math.isnan(x):
        return 1.0
    if math.isinf(x):
        return 0.0
    h = x / 2
    if dof % 2 == 0:
        term = total = 1.0
        for i in range(1, dof // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    term, total = math.sqrt(h) / math.gamma(1.5), 0.0
    for i in range(1, dof // 2 + 1):
        total += term
        term *= h / (i + 0.5)
    return math.erfc(math.sqrt(h)) + math.exp(-h) * total


def _ks_tail(d: float, n_ref: int, n_cur: int) -> float:
    """Asymptotic two-sided Kolmogorov-Smirnov p-value."""
    x = d * math.sqrt(n_ref * n_cur / (n_ref + n_cur))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_tail(d: float, n_ref: int, n_cur: int, exact_rows: int = EXACT_ROWS) -> float:
    """Exact two-sided Kolmogorov-Smirnov p-value: P(distance of two samples >= d).

    Orders of the two samples are lattice paths from (0, 0) to (n_ref, n_cur), all
    equally likely; the paths that stay closer to the diagonal than d are counted
    column by column, scaled so that no number grows. With more than ``exact_rows``
    on a side the asymptotic tail is taken.
    """
    n, m = sorted((int(n_ref), int(n_cur)))
    if m > exact_rows:
        return _ks_tail(d, n_ref, n_cur)
    parts = math.lcm(n, m)
    steps_n, steps_m = parts // n, parts // m
    most = round(d * parts) - 1  # |i / n - j / m| * parts may be at most this
    if most < 0:
        return 1.0
    j = np.arange(m + 1)
    ways = (j * steps_m <= most).astype(float)  # paths along the first column
    scale = 0.0
    for i in range(1, n + 1):
        ways = np.cumsum(np.where(np.abs(i * steps_n - j * steps_m) <= most, ways, 0.0))
        ways[np.abs(i * steps_n - j * steps_m) > most] = 0.0
        top = ways.max()
        if top == 0.0:
            return 1.0
        ways /= top
        scale += math.log(top)
    inside = math.exp(scale + math.log(ways[m]) - math.lgamma(n + m + 1) + math.lgamma(n + 1) + math.lgamma(m + 1)) if ways[m] else 0.0
    return min(1.0, max(0.0, 1.0 - inside))


@F.pandas_udf(T.DoubleType())
def p_value(
    test: pd.Series, stat: pd.Series, levels: pd.Series, n_ref: pd.Series, n_cur: pd.Series, exact: pd.Series
) -> pd.Series:
    """One value per compared column, so the input has as many rows as columns."""

    def one(t, s, k, a, b, e):
        if t == "ks":
            return ks_tail(s, a, b, e)
        if t == "chi_square":
            return _upper_tail(s, int(k) - 1)
        return math.erfc(math.sqrt(s / 2)) if t == "z_test" else None

    return pd.Series([one(*row) for row in zip(test, stat, levels, n_ref, n_cur, exact)], dtype="float64")


# --- report and decision -----------------------------------------------------


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    method: str = "auto",
    base: float = math.e,
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """column_name, test, statistic, p_value, drifted for every column.

    ``distance`` compares by Wasserstein (numeric) and Jensen-Shannon distance;
    ``test`` by Kolmogorov-Smirnov, and chi-square or, with two levels,
    proportions. ``auto`` takes tests for columns of at most ``SMALL_ROWS``
    reference values, distances for longer ones, and compares numeric columns of
    at most ``FEW_LEVELS`` distinct values as levels; the other two methods take
    each column as the kind it is passed as.
    """
    parts = []
    if numeric:
        parts.append(numeric_drift(reference, current, numeric, base).withColumn("_numeric", F.lit(True)))
    if categorical:
        parts.append(
            category_drift(reference, current, categorical, base).select(
                "*",
                F.lit(None).cast("double").alias("wasserstein"),
                F.lit(None).cast("double").alias("ks"),
                F.lit(False).alias("_numeric"),
            )
        )
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if method == "auto":
        measured = F.col("_numeric") & (F.col("n_levels") > FEW_LEVELS)
        by_distance = F.col("rows_ref") > SMALL_ROWS
    else:
        measured = F.col("_numeric")
        by_distance = F.lit({"distance": True, "test": False}[method])
    name = (
        F.when(by_distance & measured, "wasserstein")
        .when(by_distance, "jensen_shannon")
        .when(measured, "ks")
        .when(F.col("n_levels") > 2, "chi_square")
        .otherwise("z_test")
    )
    stat = (
        F.when(F.col("test") == "wasserstein", F.col("wasserstein"))
        .when(F.col("test") == "jensen_shannon", F.col("js_distance"))
        .when(F.col("test") == "ks", F.col("ks"))
        .when(F.col("test") == "chi_square", F.col("chi2"))
        .otherwise(F.col("homogeneity"))
    )
    out = table.withColumn("test", name).withColumn("statistic", stat)
    if method == "distance":
        out = out.withColumn("p_value", F.lit(None).cast("double"))
    else:
        out = out.withColumn("p_value", p_value("test", "statistic", "n_levels", "rows_ref", "rows_cur", F.lit(exact_rows)))
    is_distance = F.col("test").isin("wasserstein", "jensen_shannon")
    drifted = F.when(is_distance, F.col("statistic") >= DISTANCE_LIMIT).otherwise(F.col("p_value") < P_VALUE_LIMIT)
    return out.select(
        "column_name",
        "test",
        "statistic",
        F.when(~is_distance, F.col("p_value")).alias("p_value"),
        drifted.alias("drifted"),
    )


def drift_share(report: DataFrame) -> DataFrame:
    """Share and number of drifted columns; (NaN, 0) when nothing was compared."""
    return report.agg(
        F.coalesce(F.avg(F.col("drifted").cast("int")), F.lit(math.nan)).alias("share"),
        F.coalesce(F.sum(F.col("drifted").cast("bigint")), F.lit(0)).alias("n_drifted"),
    )


def retraining_decision(share: DataFrame, threshold: float = DRIFT_SHARE) -> DataFrame:
    """Add the trigger (share strictly above the threshold) and its message."""
    above = F.coalesce((F.col("share") > threshold) & ~F.isnan("share"), F.lit(False))
    text = F.when(
        above, F.format_string("%.0f%% of columns drifted, above %.0f%%: retrain", F.col("share") * 100, F.lit(threshold * 100))
    ).otherwise(
        F.format_string(
            "%.0f%% of columns drifted, not above %.0f%%: keep the model", F.col("share") * 100, F.lit(threshold * 100)
        )
    )
    return share.select("*", F.lit(float(threshold)).alias("threshold"), above.alias("retrain"), text.alias("message"))
