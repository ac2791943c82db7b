"""Queries on models, metrics, calibration, conformal sets and the audit."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from riskframe.operators import score as scoring
from riskframe.operators import wide as wides
from riskframe.operators import attrib, audit, calibrate, conformal, metrics, model, prep, split
from riskframe.plans.catalog_prep import DOC_CATEGORICAL, vocabulary_sql
from riskframe.plans.catalog_split import folds_sql
from riskframe.plans.standins import LABELLED, rounded, sql, view
from riskframe.session import materialize, new_shared_path
from riskframe.sources import bundle as bundles

QUERIES: dict = {}
ORACLES: dict = {}

DOC_SPEC = prep.FeatureSpec(["n_chars"], DOC_CATEGORICAL)
WIDE_SPEC = prep.FeatureSpec(["total", "quantity", "discount", "n_lines"], ["priority", "segment_id"])


def scored(spark, d) -> DataFrame:
    return view(spark, d, "scored")


# --- weights and metrics -----------------------------------------------------

QUERIES["class_weights"] = lambda spark, d: rounded(model.class_weights(scored(spark, d), "y"))
ORACLES["class_weights"] = sql(
    """WITH n AS (SELECT y AS label, count(*) AS n FROM scored GROUP BY y)
    SELECT label, n, round((SELECT sum(n) FROM n) / (2.0 * n), 6) AS balanced,
    round(CASE WHEN label = 1 THEN (SELECT n FROM n WHERE label = 0) / (SELECT n FROM n WHERE label = 1)
          ELSE 1.0 END, 6) AS positive_ratio FROM n""",
    "scored",
)


def metrics_sql(source: str, *groups: str, score: str = "p", label: str = "y") -> str:
    """Ranking metrics by whole-table windows over the distinct scores."""
    g = "".join(f"{c}, " for c in groups)
    part = f"PARTITION BY {', '.join(groups)}" if groups else ""
    by = f"GROUP BY {', '.join(groups)}" if groups else ""
    return f"""SELECT {g}CAST(sum(tp + fp) AS BIGINT) AS n, sum(tp) / sum(tp + fp) AS actual_rate,
        sum(s * (tp + fp)) / sum(tp + fp) AS mean_score,
        sum(tp * ctp / (ctp + cfp)) / nullif(sum(tp), 0) AS average_precision,
        sum(tp * (nn - cfp) + 0.5 * tp * fp) / nullif(sum(tp) * max(nn), 0) AS roc_auc,
        sum(tp * (1 - s) * (1 - s) + fp * s * s) / sum(tp + fp) AS brier
    FROM (SELECT *, sum(tp) OVER ({part} ORDER BY s DESC) AS ctp, sum(fp) OVER ({part} ORDER BY s DESC) AS cfp,
                 sum(fp) OVER ({part}) AS nn
          FROM (SELECT {g}{score} AS s, CAST(sum({label}) AS DOUBLE) AS tp, CAST(sum(1 - {label}) AS DOUBLE) AS fp
                FROM {source} GROUP BY {g}{score})) {by}"""


for name, column in {"metric_ap": "average_precision", "metric_auc": "roc_auc"}.items():
    op = metrics.average_precision if column == "average_precision" else metrics.roc_auc
    QUERIES[name] = lambda spark, d, op=op: rounded(op(scored(spark, d), "p", "y"))
    ORACLES[name] = sql(f"SELECT round({column}, 6) AS {column} FROM ({metrics_sql('scored')})", "scored")
QUERIES["metric_brier"] = lambda spark, d: rounded(metrics.brier(scored(spark, d), "p", "y"))
ORACLES["metric_brier"] = sql("SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM scored", "scored")


def folded_scores(spark, d) -> DataFrame:
    return split.with_folds(scored(spark, d).select("patient_nbr", "y", "p"), "patient_nbr", "y", 5)


FOLDED = f"folded AS (SELECT s.*, fold FROM scored AS s JOIN ({folds_sql('scored', 5)}) AS f USING (patient_nbr))"
CV_COLUMNS = ("average_precision", "roc_auc", "brier")


def cv_metrics(spark, d) -> DataFrame:
    return metrics.ranking_metrics(folded_scores(spark, d), "p", "y", ["fold"]).select("fold", *CV_COLUMNS)


QUERIES["cv_metrics"] = lambda spark, d: rounded(cv_metrics(spark, d))
ORACLES["cv_metrics"] = sql(
    f"WITH {FOLDED} SELECT fold, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in CV_COLUMNS)
    + f" FROM ({metrics_sql('folded', 'fold')})",
    "scored",
)
QUERIES["cv_summary"] = lambda spark, d: rounded(metrics.cv_summary(cv_metrics(spark, d)))
ORACLES["cv_summary"] = sql(
    f"WITH {FOLDED}, m AS ({metrics_sql('folded', 'fold')}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM m" for c in CV_COLUMNS
    ),
    "scored",
)
QUERIES["calibration_curve"] = lambda spark, d: rounded(
    metrics.calibration_curve(scored(spark, d), ["p", "p2"], "y"), 6
)


def curve_sql(score: str) -> str:
    inner = " + ".join(
        f"(CASE WHEN {score} > (SELECT quantile_cont({score}, {i / 10}) FROM scored) THEN 1 ELSE 0 END)" for i in range(1, 10)
    )
    return (
        f"SELECT '{score}' AS score_name, CAST({inner} AS INT) AS bin, count(*) AS n, "
        f"round(avg({score}), 6) AS mean_predicted, round(avg(y), 6) AS observed_rate FROM scored GROUP BY 2"
    )


ORACLES["calibration_curve"] = sql(" UNION ALL ".join(curve_sql(s) for s in ("p", "p2")), "scored")

# --- calibration -------------------------------------------------------------


def calib_isotonic(spark, d) -> DataFrame:
    rows = scored(spark, d)
    fitted = calibrate.fit_isotonic(rows, "p", "y")
    return rounded(fitted.apply(rows.select("p").distinct(), "p", "calibrated"))


QUERIES["calib_isotonic"] = calib_isotonic
ORACLES["calib_isotonic"] = sql(
    """WITH lev AS (SELECT p, row_number() OVER (ORDER BY p) AS i, s, w FROM (
           SELECT p, CAST(sum(y) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS w FROM scored GROUP BY p)),
    cum AS (SELECT p, i, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw, s, w FROM lev),
    mean AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m
             FROM cum AS a JOIN cum AS b ON a.i <= b.i),
    low AS (SELECT a, cum.i, min(m) AS m FROM mean JOIN cum ON a <= cum.i AND b >= cum.i GROUP BY ALL)
    SELECT p, round(max(m), 6) AS calibrated FROM low JOIN cum USING (i) GROUP BY p""",
    "scored",
)


def newton_sql(levels: str, steps: int, ridge: str = "0") -> str:
    """Weighted logistic regression z = u + v x by unrolled Newton steps.

    ``levels`` has x, t (weighted target sum) and w (weight sum).
    """
    out = [f"lev AS ({levels})", "b0 AS (SELECT CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v)"]
    for k in range(steps):
        out.append(
            f"""g{k} AS (SELECT max(u) AS u, max(v) AS v, sum(t - w * q) AS gu, sum(x * (t - w * q)) - max(v) * {ridge} AS gv,
            sum(w * q * (1 - q)) AS h00, sum(w * q * (1 - q) * x) AS h01, sum(w * q * (1 - q) * x * x) + {ridge} AS h11
            FROM (SELECT x, t, w, u, v, 1 / (1 + exp(-(u + v * x))) AS q FROM lev, b{k}))"""
        )
        out.append(
            f"""b{k + 1} AS (SELECT u + (h11 * gu - h01 * gv) / (h00 * h11 - h01 * h01) AS u,
            v + (h00 * gv - h01 * gu) / (h00 * h11 - h01 * h01) AS v FROM g{k})"""
        )
    return ", ".join(out)


def calib_sigmoid(spark, d) -> DataFrame:
    rows = scored(spark, d)
    fitted = calibrate.fit_sigmoid(rows, "p", "y")
    return rounded(fitted.apply(rows.select("p").distinct(), "p", "calibrated"), 5, p=6)


SIGMOID_LEVELS = """SELECT p AS x, sum(CASE WHEN y = 1 THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n0 + 2) END) AS t,
    CAST(count(*) AS DOUBLE) AS w
    FROM scored, (SELECT CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM scored) GROUP BY p"""
QUERIES["calib_sigmoid"] = calib_sigmoid
ORACLES["calib_sigmoid"] = sql(
    f"""WITH {newton_sql(SIGMOID_LEVELS, 10)}
    SELECT round(x, 6) AS p, round(1 / (1 + exp(-(u + v * x))), 5) AS calibrated FROM lev, b10""",
    "scored",
)


def calib_select(spark, d) -> DataFrame:
    return rounded(calibrate.select_method(calibrate.brier_by_method(scored(spark, d), "y", {"raw": "p", "mixed": "p2"})))


QUERIES["calib_select"] = calib_select
ORACLES["calib_select"] = sql(
    """SELECT method, round(brier, 6) AS brier FROM (
    SELECT 'raw' AS method, avg((p - y) * (p - y)) AS brier FROM scored UNION ALL
    SELECT 'mixed' AS method, avg((p2 - y) * (p2 - y)) AS brier FROM scored) ORDER BY brier, method LIMIT 1""",
    "scored",
)

CALIBRATION_ROWS = "encounter_id % 2 = 0"  # both calibrators learn from these, the others choose


def calib_choice(spark, d) -> DataFrame:
    """Brier score of the isotonic and the sigmoid calibration on rows neither has seen; the lower is chosen."""
    rows = materialize(scored(spark, d).select("encounter_id", "y", "p"), "scored")
    judged = rows.where(f"NOT ({CALIBRATION_ROWS})")
    for method in calibrate.METHODS:
        judged = calibrate.fit_calibration(rows.where(CALIBRATION_ROWS), "p", "y", method).apply(judged, "p", method)
    return rounded(calibrate.brier_by_method(judged, "y", {m: m for m in calibrate.METHODS}), 5)


FIT_SQL = f"fit AS (SELECT * FROM scored WHERE {CALIBRATION_ROWS}), judged AS (SELECT * FROM scored WHERE NOT ({CALIBRATION_ROWS}))"
ISOTONIC_SQL = """pool AS (SELECT p, row_number() OVER (ORDER BY p) AS i, s, w FROM (
        SELECT p, CAST(sum(y) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS w FROM fit GROUP BY p)),
    cum AS (SELECT p, i, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw, s, w FROM pool),
    mean AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m
             FROM cum AS a JOIN cum AS b ON a.i <= b.i),
    low AS (SELECT a, cum.i, min(m) AS m FROM mean JOIN cum ON a <= cum.i AND b >= cum.i GROUP BY ALL),
    iso AS (SELECT p, max(m) AS c FROM low JOIN cum USING (i) GROUP BY p),
    near AS (SELECT j.y, j.p, lo.p AS lp, lo.c AS lc, hi.p AS hp, hi.c AS hc FROM judged AS j
             ASOF LEFT JOIN iso AS lo ON j.p >= lo.p ASOF LEFT JOIN iso AS hi ON j.p <= hi.p),
    stepped AS (SELECT y, CASE WHEN lp IS NULL THEN hc WHEN hp IS NULL THEN lc WHEN lp = hp THEN lc
                          ELSE lc + (hc - lc) * (p - lp) / (hp - lp) END AS q FROM near)"""
QUERIES["calib_choice"] = calib_choice
ORACLES["calib_choice"] = sql(
    f"""WITH {FIT_SQL}, {ISOTONIC_SQL}, {newton_sql(SIGMOID_LEVELS.replace('FROM scored', 'FROM fit'), 10)}
    SELECT 'isotonic' AS method, round(avg((q - y) * (q - y)), 5) AS brier FROM stepped UNION ALL
    SELECT 'sigmoid' AS method, round(avg((1 / (1 + exp(-(u + v * p))) - y) * (1 / (1 + exp(-(u + v * p))) - y)), 5) AS brier
    FROM judged, b10""",
    "scored",
)

# --- conformal prediction ----------------------------------------------------

LEVEL = 0.9
CONFORM = "encounter_id % 2 = 0"  # rows the threshold is learned on; the others are tested
THRESHOLD_SQL = f"""thr AS (SELECT n, k, s AS threshold FROM (
    SELECT 1 - (CASE WHEN y = 1 THEN p2 ELSE 1 - p2 END) AS s, count(*) OVER () AS n,
           least(count(*) OVER (), CAST(ceil((count(*) OVER () + 1) * {LEVEL} - 1e-12) AS BIGINT)) AS k,
           row_number() OVER (ORDER BY 1 - (CASE WHEN y = 1 THEN p2 ELSE 1 - p2 END)) AS r
    FROM scored WHERE {CONFORM}) WHERE r = k)"""
IN_0 = "1 - (1 - p2) <= threshold"
IN_1 = "1 - p2 <= threshold"


def threshold(spark, d) -> tuple[int, int, float]:
    return conformal.conformal_threshold(scored(spark, d).where(CONFORM), "p2", "y", LEVEL)


def conformal_threshold(spark, d) -> DataFrame:
    return rounded(spark.createDataFrame([threshold(spark, d)], "n bigint, k bigint, threshold double"))


def conformal_sets(spark, d) -> DataFrame:
    cut = threshold(spark, d)[2]
    tested = scored(spark, d).where(f"NOT ({CONFORM})").select("encounter_id", "y", "p2")
    return conformal.with_prediction_set(tested, "p2", cut)


QUERIES["conformal_threshold"] = conformal_threshold
ORACLES["conformal_threshold"] = sql(
    f"WITH {THRESHOLD_SQL} SELECT n, k, round(threshold, 6) AS threshold FROM thr", "scored"
)
QUERIES["conformal_sets"] = lambda spark, d: conformal_sets(spark, d).select(
    "encounter_id", F.array_join(F.col("prediction_set").cast("array<string>"), ",").alias("prediction_set")
)
ORACLES["conformal_sets"] = sql(
    f"""WITH {THRESHOLD_SQL} SELECT encounter_id, concat_ws(',', CASE WHEN {IN_0} THEN '0' END,
    CASE WHEN {IN_1} THEN '1' END) AS prediction_set FROM scored, thr WHERE NOT ({CONFORM})""",
    "scored",
)
QUERIES["conformal_coverage"] = lambda spark, d: rounded(
    metrics.coverage_and_size(conformal_sets(spark, d), "prediction_set", "y")
)
ORACLES["conformal_coverage"] = sql(
    f"""WITH {THRESHOLD_SQL} SELECT
    round(avg(CASE WHEN (y = 1 AND {IN_1}) OR (y = 0 AND {IN_0}) THEN 1.0 ELSE 0.0 END), 6) AS coverage,
    round(avg((CASE WHEN {IN_0} THEN 1.0 ELSE 0.0 END) + (CASE WHEN {IN_1} THEN 1.0 ELSE 0.0 END)), 6) AS mean_size
    FROM scored, thr WHERE NOT ({CONFORM})""",
    "scored",
)

# --- subgroup audit ----------------------------------------------------------

ATTRIBUTES = ["priority", "segment", "kind"]
LONG_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, {a} AS subgroup, y, p FROM scored WHERE {a} IS NOT NULL" for a in ATTRIBUTES
) + f"), sub AS ({metrics_sql('long', 'attribute', 'subgroup')})"


def subgroups(spark, d) -> DataFrame:
    return audit.subgroup_metrics(scored(spark, d), "y", "p", ATTRIBUTES, digits=None)


QUERIES["subgroup_metrics"] = lambda spark, d: rounded(subgroups(spark, d))
ORACLES["subgroup_metrics"] = sql(
    f"""WITH {LONG_SQL} SELECT attribute, subgroup, n, round(actual_rate, 6) AS actual_rate,
    round(mean_score, 6) AS mean_risk, round(roc_auc, 6) AS roc_auc FROM sub""",
    "scored",
)
QUERIES["subgroup_gap"] = lambda spark, d: rounded(audit.subgroup_gap(subgroups(spark, d)))
ORACLES["subgroup_gap"] = sql(
    f"""WITH {LONG_SQL} SELECT attribute, count(*) AS n_groups, round(max(roc_auc) - min(roc_auc), 6) AS auc_gap
    FROM sub WHERE n >= 200 AND roc_auc IS NOT NULL GROUP BY attribute HAVING count(*) >= 2""",
    "scored",
)

# --- trained models ----------------------------------------------------------


def documents(spark, d) -> DataFrame:
    return view(spark, d, "docs")


def labelled(spark, d) -> DataFrame:
    return documents(spark, d).where(LABELLED)


def lr_line(spark, d) -> DataFrame:
    """Balanced, penalised regression on one standardised feature; scores of all documents."""
    docs = documents(spark, d)
    fitted = model.fit_model(docs.where(LABELLED), prep.FeatureSpec(["n_chars"], []), "quality", model.logistic_learner())
    return rounded(model.score(docs, fitted).select("doc_id", "p"), 4)


LINE_LEVELS = """SELECT (n_chars - m) / s AS x, sum(CASE WHEN quality = 1 THEN n / (2 * n1) ELSE 0 END) AS t,
    sum(CASE WHEN quality = 1 THEN n / (2 * n1) ELSE n / (2 * (n - n1)) END) AS w
    FROM docs, (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s, CAST(count(*) AS DOUBLE) AS n,
                       CAST(sum(quality) AS DOUBLE) AS n1 FROM docs WHERE quality IS NOT NULL)
    WHERE quality IS NOT NULL GROUP BY 1"""
QUERIES["lr_line"] = lr_line
ORACLES["lr_line"] = sql(
    f"""WITH {newton_sql(LINE_LEVELS, 10, '1')}
    SELECT doc_id, round(1 / (1 + exp(-(u + v * (n_chars - m) / s))), 4) AS p
    FROM docs, b10, (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM docs WHERE quality IS NOT NULL)""",
    "docs",
)


def lr_score(spark, d) -> DataFrame:
    wide = materialize(view(spark, d, "wide"), "wide")
    fitted = model.fit_model(wide, WIDE_SPEC, "y", model.logistic_learner())
    return model.score(wide, fitted).select("o_orderkey", "y", "p")


def lr_gradient(spark, d) -> DataFrame:
    """Per feature: whether the penalised loss is flat at the fitted coefficients.

    At the optimum, the weighted errors times the feature's values and the
    coefficient (the penalty's share) add up to nothing.
    """
    wide = materialize(view(spark, d, "wide"), "wide")
    fitted = model.fit_model(wide, WIDE_SPEC, "y", model.logistic_learner())
    n0, n1 = wide.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    n = n0 + n1
    weight = F.when(F.col("y") == 1, n / (2 * n1)).otherwise(n / (2 * n0))
    error = weight * (vector_to_array("probability")[1] - F.col("y"))
    _, indices, values = prep.sparse_parts()
    constant = F.array(F.struct(F.lit(-1).alias("i"), F.lit(1.0).alias("v")))
    cells = F.explode(F.concat(F.arrays_zip(indices.alias("i"), values.alias("v")), constant))
    sums = (
        fitted.stages.transform(wide)
        .select(error.alias("error"), cells.alias("c"))
        .groupBy(F.col("c.i").alias("i"))
        .agg(F.sum(F.col("error") * F.col("c.v")).alias("pull"))
    )
    solved = [*enumerate(zip(fitted.names, fitted.classifier.coefficients.tolist())), (-1, ("intercept", 0.0))]
    named = spark.createDataFrame([(i, name, c) for i, (name, c) in solved], "i int, feature string, coef double")
    flat = F.abs(F.col("pull") + F.col("coef")) / n < 1e-5
    return named.join(sums, "i").select("feature", flat.alias("flat"))  # one row per feature


QUERIES["lr_gradient"] = lr_gradient
ORACLES["lr_gradient"] = sql(
    f"""WITH vocab AS ({vocabulary_sql('wide', WIDE_SPEC.categorical)})
    SELECT DISTINCT slot AS feature, true AS flat FROM vocab UNION ALL
    SELECT unnest(['intercept', {', '.join(f"'{c}'" for c in WIDE_SPEC.numeric)}]) AS feature, true AS flat""",
    "wide",
)


def lr_wide(spark, d) -> DataFrame:
    """Per feature: whether the loss is flat at the coefficients that were fitted as a table."""
    wide = materialize(view(spark, d, "wide"), "wide")
    stats = prep.fit_stats(wide, prep.FeatureSpec(WIDE_SPEC.numeric, []))["all"].numeric
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(v.median)) for c, v in stats.items()}
    numbers = [F.struct(F.lit(c).alias("feature"), ((x - stats[c].mean) / stats[c].std).alias("value")) for c, x in filled.items()]
    vocabulary = materialize(prep.onehot_vocabulary(wide, WIDE_SPEC.categorical), "vocabulary")
    cells = prep.onehot_long(wide, "o_orderkey", WIDE_SPEC.categorical, vocabulary).unionByName(
        wide.select("o_orderkey", F.explode(F.array(*numbers)).alias("c")).select("o_orderkey", "c.*")
    )
    found = wides.fit_wide(cells, wide.select("o_orderkey", "y"), "o_orderkey", "y", tolerance=5e-6)
    constant = spark.createDataFrame([("intercept", found.intercept_gradient)], "feature string, gradient double")
    every = found.table.select("feature", "gradient").unionByName(constant)
    return every.select("feature", (F.abs("gradient") / found.n_rows < 1e-5).alias("flat"))


QUERIES["lr_wide"] = lr_wide
ORACLES["lr_wide"] = ORACLES["lr_gradient"]

#: Boosters by session and folder: the four boosted queries share one fit.
FITTED: dict = {}


def fitted_boost(spark, d):
    """The documents and the tuned booster of the labelled ones."""
    docs, key = documents(spark, d), (spark.sparkContext.applicationId, d)
    if key not in FITTED:
        learner = model.boosted_learner(model.TUNED_BOOST)
        FITTED[key] = model.fit_model(docs.where(LABELLED), DOC_SPEC, "quality", learner)
    return docs, FITTED[key]


def gbt_score(spark, d) -> DataFrame:
    docs, fitted = fitted_boost(spark, d)
    return model.score(docs, fitted).select("doc_id", "quality", "p")


def cv_lr(spark, d) -> DataFrame:
    folded = model.folded_table(labelled(spark, d), DOC_SPEC, "quality", "shard", 5)
    return model.grouped_cv_scores(folded, model.logistic_learner())


QUERIES["lr_score"] = lr_score
QUERIES["gbt_score"] = gbt_score
QUERIES["cv_lr"] = cv_lr


def score_bundle(spark, d) -> DataFrame:
    """Every document's score record from the tuned, calibrated booster, saved as a bundle and loaded again."""
    docs, fitted = fitted_boost(spark, d)
    known = materialize(model.score(docs.where(LABELLED), fitted).select(F.col("quality").alias("y"), "p"), "known")
    calibration = calibrate.fit_calibration(known, "p", "y", "sigmoid")
    level = conformal.LEVEL
    _, _, cut = conformal.conformal_threshold(calibration.apply(known, "p", "risk"), "risk", "y", level)
    path = new_shared_path(spark, "bundle")
    bundles.save_bundle(spark, scoring.Bundle(fitted, calibration, cut, level, attrib.explainer(fitted)), path)
    scored = scoring.score_batch(docs, bundles.load_bundle(spark, path), ["doc_id"])
    return scored.select(
        "doc_id", "risk", "risk_label", F.size("prediction_set").alias("n_labels"), F.size("top_reasons").alias("n_reasons")
    )


QUERIES["score_bundle"] = score_bundle


def explained_boost(spark, d):
    docs, fitted = fitted_boost(spark, d)
    return docs, fitted, attrib.explainer(fitted)


def attrib_tree(spark, d) -> DataFrame:
    docs, fitted, explain = explained_boost(spark, d)
    return attrib.model_contributions(docs, fitted, explain, "doc_id")


def attrib_tree_gap(spark, d) -> DataFrame:
    """Per row: log-odds minus base minus the contributions (must be nothing)."""
    docs, fitted, explain = explained_boost(spark, d)
    p = F.col("p")
    margin = model.score(docs, fitted).select("doc_id", F.log(p / (1 - p)).alias("margin"))
    sums = (
        attrib.model_contributions(docs, fitted, explain, "doc_id")
        .groupBy("doc_id")
        .agg(F.sum("contribution").alias("total"))
    )
    gap = F.abs(F.col("margin") - explain.base - F.coalesce("total", F.lit(0.0)))
    return margin.join(sums, "doc_id", "left").select("doc_id", (gap < 1e-9).alias("adds_up"))


QUERIES["attrib_tree"] = attrib_tree
QUERIES["attrib_tree_gap"] = attrib_tree_gap
ORACLES["attrib_tree_gap"] = sql("SELECT doc_id, true AS adds_up FROM docs", "docs")
QUERIES["attrib_tree_global"] = lambda spark, d: attrib.model_importance(*explained_boost(spark, d))
