"""Stand-ins for the encounter table, derived from the order tables.

Each is one SELECT that both engines read the same way; ``{orders}`` and the
like name the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("orders", "lineitem", "customer", "events", "documents", "labels")

# One order plays one encounter, its customer the patient.
ENC = """
SELECT o_orderkey AS encounter_id,
       o_custkey AS patient_nbr,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Caucasian' WHEN '2-HIGH' THEN 'AfricanAmerican'
            WHEN '3-MEDIUM' THEN 'Hispanic' WHEN '4-NOT SPECIFIED' THEN '?' ELSE 'Martian' END AS race,
       CASE WHEN o_orderkey % 97 = 0 THEN 'Unknown/Invalid' WHEN o_custkey % 2 = 0 THEN 'Male'
            WHEN o_orderkey % 89 = 0 THEN 'X' ELSE 'Female' END AS gender,
       CASE WHEN o_orderkey % 53 = 0 THEN '42' ELSE
            concat('[', CAST(CAST(floor(o_totalprice / 50001) AS INT) * 10 AS STRING), '-',
                   CAST(CAST(floor(o_totalprice / 50001) AS INT) * 10 + 10 AS STRING), ')') END AS age,
       CASE WHEN o_orderkey % 31 = 0 THEN '[75-100)' ELSE '?' END AS weight,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(o_orderkey % 30 AS INT) END AS discharge_disposition_id,
       CAST(o_custkey % 7 AS INT) AS admission_type_id,
       CAST(o_orderkey % 16 AS INT) AS time_in_hospital,
       CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 5000) AS INT) END AS num_lab_procedures,
       CAST(o_orderkey % 6 AS INT) AS num_procedures,
       CAST(floor(o_totalprice / 7000) AS INT) AS num_medications,
       CAST(o_custkey % 9 - 1 AS INT) AS number_outpatient,
       CAST(o_orderkey % 3 AS INT) AS number_emergency,
       CAST((o_orderkey + o_custkey) % 4 AS INT) AS number_inpatient,
       CAST(o_custkey % 17 AS INT) AS number_diagnoses,
       CASE WHEN o_orderkey % 13 = 0 THEN concat('V', CAST(o_orderkey % 90 AS STRING))
            WHEN o_orderkey % 17 = 0 THEN '?'
            ELSE concat(CAST(o_custkey % 1000 AS STRING), '.', CAST(o_orderkey % 100 AS STRING)) END AS diag_1,
       CASE WHEN o_orderkey % 19 = 0 THEN concat('E', CAST(o_orderkey % 90 AS STRING))
            WHEN o_orderkey % 23 = 0 THEN '?' ELSE CAST(o_orderkey % 1000 AS STRING) END AS diag_2,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN '2x50'
            ELSE CAST((o_orderkey * 7 + o_custkey) % 1000 AS STRING) END AS diag_3,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Ch' ELSE 'No' END AS change,
       CASE WHEN o_orderkey % 71 = 0 THEN 'Maybe' WHEN o_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS diabetesMed,
       CASE WHEN o_orderkey % 5 = 0 THEN 'Norm' WHEN o_orderkey % 5 = 1 THEN '>7' ELSE 'None' END AS A1Cresult,
       CASE WHEN o_custkey % 4 = 0 THEN 'Cardiology' WHEN o_custkey % 4 = 1 THEN 'Surgery' ELSE '?' END AS medical_specialty,
       'No' AS examide,
       CASE o_orderstatus WHEN 'P' THEN '<30' WHEN 'O' THEN '>30' ELSE 'NO' END AS readmitted
FROM {orders}
"""

# Scores are rounded so that many rows tie.
SCORED = """
SELECT o_orderkey AS encounter_id, o_custkey AS patient_nbr,
       CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS y,
       floor(o_totalprice / 5001) / 1e2 AS p,
       floor(o_totalprice / 5001) / 2e2 + (o_orderkey % 10) / 2e1 AS p2,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS priority,
       c_mktsegment AS segment,
       CASE WHEN o_custkey % 50 = 0 THEN 'rare' ELSE 'common' END AS kind
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

# Line items carry the codes; whole and dotted codes, prefixes and sentinels.
CODES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_linenumber = 7 THEN concat('V', CAST(l_partkey % 100 AS STRING))
            WHEN l_linenumber = 6 THEN concat('E', CAST(l_partkey % 1000 AS STRING))
            WHEN l_partkey % 37 = 0 THEN NULL
            WHEN l_suppkey % 3 = 0 THEN CAST(l_partkey % 1000 AS STRING)
            ELSE concat(CAST(l_partkey % 1000 AS STRING), '.', CAST(l_suppkey % 100 AS STRING)) END AS code
FROM {lineitem}
"""

# Orders with their lines' sums; orders without lines have real NULLs.
WIDE = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS y, o_totalprice AS total,
       quantity, discount, CAST(n_lines AS DOUBLE) AS n_lines,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS priority,
       CAST(o_custkey % 8 AS INT) AS segment_id
FROM {orders} LEFT JOIN (
    SELECT l_orderkey, sum(l_quantity) AS quantity, sum(CAST(round(l_discount * 100) AS INT)) / 1e2 AS discount,
           count(*) AS n_lines
    FROM {lineitem} GROUP BY l_orderkey) AS lines ON o_orderkey = l_orderkey
"""

# All documents, with their human label where there is one: a real binary target and rare levels.
DOCS = """
SELECT d.doc_id AS doc_id, quality, n_chars, lang, concat(lang, '/', source) AS origin,
       CAST(d.doc_id % 40 AS INT) AS shard
FROM {documents} AS d LEFT JOIN {labels} AS l ON d.doc_id = l.doc_id
"""
LABELLED = "quality IS NOT NULL"

EVENTS_REF = "SELECT event_id, event_type, value, user_id FROM {events} WHERE ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'"
EVENTS_CUR = (
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'error' ELSE event_type END AS event_type, "
    "value * 1.2 AS value, user_id FROM {events} WHERE ts >= TIMESTAMP_NTZ '2024-01-16 00:00:00'"
)

VIEWS = {
    "enc": ENC,
    "scored": SCORED,
    "codes": CODES,
    "wide": WIDE,
    "docs": DOCS,
    "ref": EVENTS_REF,
    "cur": EVENTS_CUR,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def sql(body: str, *names: str) -> str:
    """An oracle statement with the stand-ins it reads."""
    text = {n: VIEWS[n].format(**{t: t for t in TABLES}).replace("TIMESTAMP_NTZ '", "TIMESTAMP '") for n in names}
    head = ",\n".join(f"{n} AS ({t})" for n, t in text.items())
    body = body.strip()
    if not names:
        return body
    return f"WITH {head}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"


def rounded(df: DataFrame, digits: int = 6, **columns: int) -> DataFrame:
    """Floating columns rounded, for comparison across engines."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            F.round(c, columns.get(c, digits)).alias(c) if kinds[c] in ("double", "float") else F.col(c)
            for c in df.columns
        ]
    )


def digest_sql(seed, *keys: str) -> str:
    """md5 of seed and key as the library computes it, in plain SQL."""
    return "md5(concat('" + str(seed) + "', " + ", ".join(f"'|', CAST({k} AS VARCHAR)" for k in keys) + "))"


def digest_number_sql(seed, *keys: str) -> str:
    return f"CAST(('0x' || substr({digest_sql(seed, *keys)}, 1, 8)) AS BIGINT)"
