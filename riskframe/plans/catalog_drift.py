"""Queries on stress, drift and streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from riskframe.operators import contract, drift
from riskframe.plans import encounters as enc
from riskframe.plans.catalog_data import PERSON_CONTRACT, findings_sql
from riskframe.plans.standins import VIEWS, digest_number_sql, rounded, sql, table, view
from riskframe.session import materialize, new_shared_path
from riskframe.streaming import streams, unique

QUERIES: dict = {}
ORACLES: dict = {}

# --- stress ------------------------------------------------------------------

SEED = 7


def stressed(spark, d, kind: type) -> DataFrame:
    rules = [r for r in enc.STRESS if isinstance(r, kind)]
    rows = view(spark, d, "enc")
    out = drift.stress(rows, enc.KEY, rules, SEED).select(enc.KEY, *[r.column for r in rules])
    return out.select(*[F.col(c).cast("double").alias(c) if t == "int" else F.col(c) for c, t in out.dtypes])


def numeric_sql(r: drift.NumericStress) -> str:
    out = f"CAST({r.column} AS DOUBLE)"
    if r.factor:
        out += f" * CAST({1 + r.factor!r} AS DOUBLE)"
    if r.add_max:
        out += f" + {digest_number_sql(f'{SEED}|{r.column}', 'encounter_id')} % {r.add_max + 1}"
    out = f"CAST(round_even({out}, 0) AS INT)"
    if r.low is not None:
        out = f"CASE WHEN {r.column} IS NOT NULL THEN least(greatest({out}, {r.low}), {r.high}) END"
    return f"CAST({out} AS DOUBLE) AS {r.column}"


def hit_sql(r) -> str:
    return f"{digest_number_sql(f'{SEED}|{r.column}', 'encounter_id')} / CAST(4294967296 AS DOUBLE) < {r.share}"


NUMERIC = [r for r in enc.STRESS if isinstance(r, drift.NumericStress)]
AGE = next(r for r in enc.STRESS if isinstance(r, drift.OrdinalStress))
AGES = "[" + ", ".join(f"'{a}'" for a in enc.AGE_BUCKETS) + "]"
OVERWRITES = [r for r in enc.STRESS if isinstance(r, drift.OverwriteStress)]

QUERIES["stress_numeric"] = lambda spark, d: stressed(spark, d, drift.NumericStress)
ORACLES["stress_numeric"] = sql(f"SELECT encounter_id, {', '.join(numeric_sql(r) for r in NUMERIC)} FROM enc", "enc")
QUERIES["stress_ordinal"] = lambda spark, d: stressed(spark, d, drift.OrdinalStress)
ORACLES["stress_ordinal"] = sql(
    f"""SELECT encounter_id, CASE WHEN {hit_sql(AGE)} AND list_position({AGES}, age) > 0
    THEN list_extract({AGES}, CAST(least(list_position({AGES}, age) + 1, 10) AS INT)) ELSE age END AS age FROM enc""",
    "enc",
)
QUERIES["stress_overwrite"] = lambda spark, d: stressed(spark, d, drift.OverwriteStress)
ORACLES["stress_overwrite"] = sql(
    "SELECT encounter_id, "
    + ", ".join(
        f"CASE WHEN {hit_sql(r)} THEN {'NULL' if r.value is None else repr(r.value)} ELSE {r.column} END AS {r.column}"
        for r in OVERWRITES
    )
    + " FROM enc",
    "enc",
)

# --- drift -------------------------------------------------------------------

NUMBERS = ["value", "user_id"]
CATEGORIES = ["event_type"]


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    return view(spark, d, "ref"), view(spark, d, "cur")


def both_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS column_name, v, sum(r) AS r, sum(c) AS c, sum(sum(r)) OVER () AS nr,
        sum(sum(c)) OVER () AS nc FROM (
        SELECT {column} AS v, 1.0 AS r, 0.0 AS c FROM ref UNION ALL SELECT {column} AS v, 0.0 AS r, 1.0 AS c FROM cur)
        GROUP BY v"""


NUMERIC_SQL = (
    "lev AS ("
    + " UNION ALL ".join(both_sql(c, "ref").replace(f"{c} AS v", f"CAST({c} AS DOUBLE) AS v") for c in NUMBERS)
    + """), steps AS (SELECT *, abs(sum(r) OVER w / nr - sum(c) OVER w / nc) AS gap,
        lead(v) OVER (PARTITION BY column_name ORDER BY v) - v AS step
      FROM lev WINDOW w AS (PARTITION BY column_name ORDER BY v)),
    spread AS ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, stddev_pop({c}) AS std FROM ref" for c in NUMBERS)
    + """), num AS (SELECT column_name, sum(gap * coalesce(step, 0)) / greatest(max(std), 0.001) AS wasserstein,
        max(gap) AS ks FROM steps JOIN spread USING (column_name) GROUP BY column_name)"""
)
CATEGORY_SQL = (
    "cat_lev AS ("
    + " UNION ALL ".join(both_sql(c, "ref") for c in CATEGORIES)
    + """), cat AS (SELECT column_name,
        sqrt((sum(CASE WHEN r > 0 THEN r / nr * ln(r / nr / ((r / nr + c / nc) / 2)) ELSE 0 END)
            + sum(CASE WHEN c > 0 THEN c / nc * ln(c / nc / ((r / nr + c / nc) / 2)) ELSE 0 END)) / 2) AS js_distance,
        sum((c - r * nc / nr) * (c - r * nc / nr) / (r * nc / nr)) AS chi2 FROM cat_lev GROUP BY column_name)"""
)
REPORT_SQL = f"""{NUMERIC_SQL}, {CATEGORY_SQL}, report AS (
    SELECT column_name, 'wasserstein' AS test, wasserstein AS statistic FROM num UNION ALL
    SELECT column_name, 'jensen_shannon' AS test, js_distance AS statistic FROM cat)"""


def report(spark, d) -> DataFrame:
    return drift.drift_report(*sides(spark, d), NUMBERS, CATEGORIES, method="distance")


QUERIES["drift_numeric"] = lambda spark, d: rounded(
    drift.numeric_drift(*sides(spark, d), NUMBERS).select("column_name", "wasserstein")
)
ORACLES["drift_numeric"] = sql(
    f"WITH {NUMERIC_SQL} SELECT column_name, round(wasserstein, 6) AS wasserstein FROM num", "ref", "cur"
)
QUERIES["drift_ks"] = lambda spark, d: rounded(drift.numeric_drift(*sides(spark, d), NUMBERS).select("column_name", "ks"))
ORACLES["drift_ks"] = sql(f"WITH {NUMERIC_SQL} SELECT column_name, round(ks, 6) AS ks FROM num", "ref", "cur")
QUERIES["drift_categorical"] = lambda spark, d: rounded(
    drift.category_drift(*sides(spark, d), CATEGORIES).select("column_name", "js_distance")
)
ORACLES["drift_categorical"] = sql(
    f"WITH {CATEGORY_SQL} SELECT column_name, round(js_distance, 6) AS js_distance FROM cat", "ref", "cur"
)
QUERIES["drift_chi2"] = lambda spark, d: rounded(
    drift.category_drift(*sides(spark, d), CATEGORIES).select("column_name", "chi2")
)
ORACLES["drift_chi2"] = sql(f"WITH {CATEGORY_SQL} SELECT column_name, round(chi2, 6) AS chi2 FROM cat", "ref", "cur")
QUERIES["drift_report"] = lambda spark, d: rounded(report(spark, d).drop("p_value"))
ORACLES["drift_report"] = sql(
    f"WITH {REPORT_SQL} SELECT column_name, test, round(statistic, 6) AS statistic, statistic >= 0.1 AS drifted FROM report",
    "ref",
    "cur",
)
# With the test method: the asymptotic tails, spelt out for the levels that the columns have.
QUERIES["drift_test"] = lambda spark, d: rounded(
    drift.drift_report(*sides(spark, d), NUMBERS, CATEGORIES, method="test", exact_rows=0), 5
)
ORACLES["drift_test"] = sql(
    f"""WITH {NUMERIC_SQL}, {CATEGORY_SQL}, report AS (
    SELECT num.column_name, 'ks' AS test, ks AS statistic, x,
        CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101),
            lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * x * x))))) END AS p_value
    FROM (SELECT column_name, max(ks) AS ks, max(ks) * sqrt(max(nr) * max(nc) / (max(nr) + max(nc))) AS x
          FROM num JOIN lev USING (column_name) GROUP BY column_name) AS num UNION ALL
    SELECT column_name, 'chi_square' AS test, chi2 AS statistic, NULL AS x, exp(-chi2 / 2) * (1 + chi2 / 2) AS p_value
    FROM cat JOIN (SELECT column_name, count(*) AS n FROM cat_lev GROUP BY ALL) USING (column_name) WHERE n = 5)
    SELECT column_name, test, round(statistic, 5) AS statistic, round(p_value, 5) AS p_value, p_value < 0.05 AS drifted
    FROM report""",
    "ref",
    "cur",
)


def small_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Both sides of the events with a numeric column of four values."""
    few = F.col("user_id") % 4
    return tuple(df.select("value", "user_id", "event_type", few.alias("few")) for df in sides(spark, d))


# The choice by rows and levels: ``few`` is a number of four values.
QUERIES["drift_auto"] = lambda spark, d: rounded(
    drift.drift_report(*small_sides(spark, d), [*NUMBERS, "few"], CATEGORIES).select("column_name", "test", "statistic")
)
FEW_SQL = both_sql("few", "ref").replace("few AS v", "user_id % 4 AS v")
ORACLES["drift_auto"] = sql(
    f"""WITH {NUMERIC_SQL}, {CATEGORY_SQL}, few_lev AS ({FEW_SQL}),
    levels AS (SELECT * FROM cat_lev UNION ALL SELECT column_name, CAST(v AS VARCHAR), r, c, nr, nc FROM few_lev),
    shared AS (SELECT column_name,
        sqrt((sum(CASE WHEN r > 0 THEN r / nr * ln(r / nr / ((r / nr + c / nc) / 2)) ELSE 0 END)
            + sum(CASE WHEN c > 0 THEN c / nc * ln(c / nc / ((r / nr + c / nc) / 2)) ELSE 0 END)) / 2) AS js_distance,
        sum((c - r * nc / nr) * (c - r * nc / nr) / (r * nc / nr)) AS chi2 FROM levels GROUP BY column_name),
    small AS (SELECT count(*) <= 1000 AS small FROM ref)
    SELECT column_name, CASE WHEN small THEN 'ks' ELSE 'wasserstein' END AS test,
        round(CASE WHEN small THEN ks ELSE wasserstein END, 6) AS statistic FROM num, small
    UNION ALL SELECT column_name, CASE WHEN small THEN 'chi_square' ELSE 'jensen_shannon' END,
        round(CASE WHEN small THEN chi2 ELSE js_distance END, 6) FROM shared, small""",
    "ref",
    "cur",
)

QUERIES["drift_share"] = lambda spark, d: rounded(drift.drift_share(report(spark, d)))
SHARE_SQL = """SELECT avg(CASE WHEN statistic >= 0.1 THEN 1.0 ELSE 0.0 END) AS share,
    CAST(sum(CASE WHEN statistic >= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_drifted FROM report"""
ORACLES["drift_share"] = sql(f"WITH {REPORT_SQL} SELECT round(share, 6) AS share, n_drifted FROM ({SHARE_SQL})", "ref", "cur")
QUERIES["drift_decision"] = lambda spark, d: rounded(
    drift.retraining_decision(drift.drift_share(report(spark, d)))
)
ORACLES["drift_decision"] = sql(
    f"""WITH {REPORT_SQL} SELECT round(share, 6) AS share, n_drifted, CAST(0.2 AS DOUBLE) AS threshold,
    share > 0.2 AS retrain,
    CASE WHEN share > 0.2 THEN printf('%.0f%% of columns drifted, above 20%%: retrain', CAST(share * 100 AS DOUBLE))
         ELSE printf('%.0f%% of columns drifted, not above 20%%: keep the model', CAST(share * 100 AS DOUBLE)) END AS message
    FROM ({SHARE_SQL})""",
    "ref",
    "cur",
)

# --- streams -----------------------------------------------------------------


def event_stream(spark, d) -> DataFrame:
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return streams.event_time(stream, "ts", "1 hour")


def stream_window_counts(spark, d) -> DataFrame:
    """Hourly-day counts per event type, complete after the last window."""
    out = new_shared_path(spark, "window_counts")
    counts = streams.window_counts(event_stream(spark, d), "ts", CATEGORIES, "1 day")
    streams.run_complete(counts, streams.replace_table(out), new_shared_path(spark, "stream"))
    found = spark.read.parquet(out)
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "column_name", "level", "n")


QUERIES["stream_window_counts"] = stream_window_counts
ORACLES["stream_window_counts"] = """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, 'event_type' AS column_name, event_type AS level, count(*) AS n
FROM events GROUP BY ALL"""


def stream_drift(spark, d) -> DataFrame:
    """Daily Jensen-Shannon distance of the stream from the reference days."""
    out = new_shared_path(spark, "window_drift")
    shares = streams.reference_shares(view(spark, d, "ref"), CATEGORIES)
    counts = streams.window_counts(event_stream(spark, d), "ts", CATEGORIES, "1 day")
    streams.run_complete(counts, streams.write_window_drift(shares, out), new_shared_path(spark, "stream"))
    found = spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return rounded(found)


QUERIES["stream_drift"] = stream_drift
ORACLES["stream_drift"] = sql(
    """WITH share AS (SELECT event_type, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM ref GROUP BY event_type),
    win AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL),
    size AS (SELECT window_start, CAST(sum(n) AS BIGINT) AS rows FROM win GROUP BY ALL),
    grid AS (SELECT window_start, rows, p, coalesce(n, 0) / rows AS q
             FROM size CROSS JOIN share LEFT JOIN win USING (window_start, event_type)),
    js AS (SELECT window_start, rows, sqrt(sum(p * ln(p / ((p + q) / 2))
               + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2) AS d FROM grid GROUP BY ALL)
    SELECT window_start, 'event_type' AS column_name, rows, round(d, 6) AS js_distance, d >= 0.1 AS drifted FROM js""",
    "ref",
)


# Windows that end an hour (the watermark's delay) before the last event are closed.
CLOSED_SQL = "window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def stream_closed_windows(spark, d) -> DataFrame:
    """Counts of the days that the watermark has closed, each written once."""
    out = new_shared_path(spark, "closed")
    counts = streams.window_counts(event_stream(spark, d), "ts", CATEGORIES, "1 day")
    streams.run_closed(counts, streams.write_closed(out), new_shared_path(spark, "stream")).awaitTermination()
    found = spark.read.parquet(out)
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "column_name", "level", "n")


QUERIES["stream_closed_windows"] = stream_closed_windows
ORACLES["stream_closed_windows"] = f"""
SELECT * FROM ({ORACLES["stream_window_counts"].strip()}) WHERE {CLOSED_SQL}"""


def stream_numeric_drift(spark, d) -> DataFrame:
    """Drift of the closed days' numbers, by sketches, against the reference days' stored sketch."""
    out = new_shared_path(spark, "sketch_drift")
    known = materialize(streams.reference_sketches(view(spark, d, "ref"), NUMBERS), "reference")
    windows = streams.window_sketches(event_stream(spark, d), "ts", NUMBERS, "1 day")
    write = streams.write_closed(out, lambda closed: streams.sketch_drift(closed, known))
    streams.run_closed(windows, write, new_shared_path(spark, "stream")).awaitTermination()
    found = spark.read.parquet(out).drop("window")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES["stream_numeric_drift"] = stream_numeric_drift

# The encounters as a stream with their time, one person a key, and a column that is not delivered.
STREAM_RULES = [replace(r, unique=r.name == enc.GROUP) for r in PERSON_CONTRACT.rules]
STREAM_CONTRACT = contract.Contract(enc.KEY, [*STREAM_RULES, contract.ColumnRule("payer_code", "string", nullable=True)])


def stream_contract(spark, d) -> DataFrame:
    """Findings of the contract on a stream: rows' own, repeated keys, absent columns."""
    unique.use_rocks_state(spark)
    orders = spark.readStream.schema(table(spark, d, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    text = VIEWS["enc"].replace("FROM {orders}", ", o_orderdate FROM {orders}")
    good, bad, repeats = (new_shared_path(spark, n) for n in ("good", "findings", "repeats"))
    # Orders come in no order of time, so the watermark waits for all of them.
    stream = streams.event_time(spark.sql(text, orders=orders), "o_orderdate", "36500 days")
    found = unique.unique_stream(stream, STREAM_CONTRACT, "o_orderdate").writeStream.format("parquet").option("path", repeats)
    found = found.option("checkpointLocation", new_shared_path(spark, "stream")).trigger(availableNow=True).start()
    checked = streams.check_stream(stream, STREAM_CONTRACT, good, bad, new_shared_path(spark, "stream"))
    for query in (found, checked):
        query.awaitTermination()
    columns = ["row_key", "column_name", "check_name", "failure"]
    return spark.read.schema(contract.FINDINGS_SCHEMA).parquet(f"{bad}/batch=*").select(*columns).unionByName(
        spark.read.schema(contract.FINDINGS_SCHEMA).parquet(repeats)
    )


QUERIES["stream_contract"] = stream_contract
ORACLES["stream_contract"] = (
    findings_sql(STREAM_RULES) + " UNION ALL SELECT NULL, 'payer_code', 'column_exists', NULL"
)
