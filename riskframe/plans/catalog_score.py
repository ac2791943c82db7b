"""Queries on attributions and score records of a linear score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.operators import attrib, conformal, prep, score
from riskframe.plans.standins import rounded, sql, view

QUERIES: dict = {}
ORACLES: dict = {}

# A fixed linear score over the orders' numeric columns.
COEFS = {"total": 0.0000037123457, "quantity": -0.01, "discount": 1.5, "n_lines": 0.2}
MEANS = {"total": 250000.0, "quantity": 100.0, "discount": 0.2, "n_lines": 4.0}
INTERCEPT = -1.1
THRESHOLD = 0.62
KEY = "o_orderkey"
SPEC = prep.FeatureSpec(list(COEFS), [])


def filled(df: DataFrame) -> DataFrame:
    """Orders without lines take the means."""
    return df.select(KEY, *[F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c) for c, m in MEANS.items()])


def linear(spark, d) -> DataFrame:
    """Orders with their linear score and its contributions."""
    rows = filled(view(spark, d, "wide"))
    rows = rows.withColumn("p", attrib.logistic(attrib.linear_margin(COEFS, INTERCEPT)))
    return attrib.linear_contributions(rows, COEFS, MEANS)


def d64(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


MARGIN = f"{d64(INTERCEPT)} + " + " + ".join(f"{d64(w)} * {c}" for c, w in COEFS.items())
LINEAR_SQL = (
    "filled AS (SELECT o_orderkey, "
    + ", ".join(f"coalesce({c}, {d64(m)}) AS {c}" for c, m in MEANS.items())
    + f" FROM wide), linear AS (SELECT *, 1 / (1 + exp(-({MARGIN}))) AS p, "
    + ", ".join(f"{d64(w)} * ({c} - {d64(MEANS[c])}) AS contrib_{c}" for c, w in COEFS.items())
    + " FROM filled), long AS ("
    + " UNION ALL ".join(
        f"SELECT o_orderkey, '{c}' AS feature, {c} AS value, contrib_{c} AS contribution FROM linear" for c in COEFS
    )
    + ")"
)


def long(spark, d) -> DataFrame:
    return attrib.long_contributions(linear(spark, d), KEY, list(COEFS))


def importance(spark, d, top: int = attrib.TOP_FEATURES) -> DataFrame:
    return attrib.column_importance(linear(spark, d), list(COEFS), top)


IMPORTANCE_SQL = "imp AS (SELECT feature, avg(abs(contribution)) AS importance FROM long GROUP BY feature)"

QUERIES["attrib_linear"] = lambda spark, d: rounded(long(spark, d))
ORACLES["attrib_linear"] = sql(
    f"WITH {LINEAR_SQL} SELECT o_orderkey, feature, round(value, 6) AS value, round(contribution, 6) AS contribution FROM long",
    "wide",
)
QUERIES["attrib_global"] = lambda spark, d: rounded(importance(spark, d))
ORACLES["attrib_global"] = sql(
    f"""WITH {LINEAR_SQL}, {IMPORTANCE_SQL}
    SELECT feature, round(importance, 6) AS importance FROM imp ORDER BY importance DESC, feature LIMIT 15""",
    "wide",
)
QUERIES["attrib_detail"] = lambda spark, d: rounded(attrib.effect_detail(long(spark, d), importance(spark, d)))
ORACLES["attrib_detail"] = sql(
    f"""WITH {LINEAR_SQL}, {IMPORTANCE_SQL}
    SELECT feature, o_orderkey, round(value, 6) AS value, round(contribution, 6) AS contribution FROM long
    WHERE feature IN (SELECT feature FROM imp ORDER BY importance DESC, feature LIMIT 15)""",
    "wide",
)


def attrib_local(spark, d) -> DataFrame:
    top = attrib.highest_risk(linear(spark, d), "p", KEY)
    return rounded(attrib.largest_contributions(attrib.long_contributions(top, KEY, list(COEFS))))


QUERIES["attrib_local"] = attrib_local
ORACLES["attrib_local"] = sql(
    f"""WITH {LINEAR_SQL}
    SELECT o_orderkey, feature, round(value, 6) AS value, round(contribution, 6) AS contribution FROM long
    WHERE o_orderkey = (SELECT o_orderkey FROM linear ORDER BY p DESC, o_orderkey LIMIT 1)
    ORDER BY abs(contribution) DESC, feature LIMIT 10""",
    "wide",
)


def reasons(df: DataFrame, top: int = 5) -> DataFrame:
    return df.withColumn("top_reasons", attrib.column_reasons(list(COEFS), top))


def top_reasons(spark, d) -> DataFrame:
    rows = reasons(linear(spark, d)).select(KEY, F.posexplode("top_reasons").alias("place", "r"))
    return rounded(rows.select(KEY, "place", "r.*"), 4)


QUERIES["top_reasons"] = top_reasons
ORACLES["top_reasons"] = sql(
    f"""WITH {LINEAR_SQL}, ranked AS (SELECT *, row_number() OVER (
        PARTITION BY o_orderkey ORDER BY abs(contribution) DESC, feature) AS r FROM long)
    SELECT o_orderkey, CAST(r - 1 AS INT) AS place, feature, round(contribution, 4) AS contribution,
    CASE WHEN contribution > 0 THEN 'augmente' ELSE 'diminue' END AS direction FROM ranked WHERE r <= 5""",
    "wide",
)


def records(rows: DataFrame) -> DataFrame:
    """Score records of a table that has p and the contributions."""
    p = F.col("p")
    sets = conformal.prediction_set(p, THRESHOLD, score.LABELS)
    first = F.col("top_reasons")[0]["feature"]
    return reasons(rows).select(
        KEY,
        F.round(p, 4).alias("risk"),
        score.risk_label(p).alias("risk_label"),
        F.array_join(sets, ",").alias("prediction_set"),
        F.lit(0.9).alias("confidence_level"),
        first.alias("first_reason"),
    )


RECORDS_SQL = f"""SELECT o_orderkey, round(p, 4) AS risk,
    CASE WHEN p >= 0.5 THEN 'readmission_30j' ELSE 'non_readmis' END AS risk_label,
    concat_ws(',', CASE WHEN 1 - (1 - p) <= {d64(THRESHOLD)} THEN 'non_readmis' END,
              CASE WHEN 1 - p <= {d64(THRESHOLD)} THEN 'readmission_30j' END) AS prediction_set,
    CAST(0.9 AS DOUBLE) AS confidence_level,
    (SELECT feature FROM long AS l WHERE l.o_orderkey = linear.o_orderkey
     ORDER BY abs(contribution) DESC, feature LIMIT 1) AS first_reason
    FROM linear"""
QUERIES["score_labels"] = lambda spark, d: records(linear(spark, d))
ORACLES["score_labels"] = sql(f"WITH {LINEAR_SQL} {RECORDS_SQL}", "wide")


def score_partial(spark, d) -> DataFrame:
    """Score orders whose features come as a map that lacks some of them."""
    wide = view(spark, d, "wide")
    known = F.map_filter(
        F.create_map(*[x for c in COEFS for x in (F.lit(c), F.col(c).cast("string"))]),
        lambda k, v: v.isNotNull() & ~((k == "total") & (F.col(KEY) % 3 == 0)),
    )
    rows = filled(score.partial_rows(wide.select(KEY, known.alias("features")), "features", SPEC))
    rows = rows.withColumn("p", attrib.logistic(attrib.linear_margin(COEFS, INTERCEPT)))
    return records(attrib.linear_contributions(rows, COEFS, MEANS))


QUERIES["score_partial"] = score_partial
ORACLES["score_partial"] = sql(
    f"WITH {LINEAR_SQL.replace('coalesce(total,', 'coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE total END,')} {RECORDS_SQL}",
    "wide",
)
