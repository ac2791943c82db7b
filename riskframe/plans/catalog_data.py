"""Queries on scans, the contract, cleaning and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.operators import clean, contract, profile
from riskframe.operators.contract import ColumnRule, Contract
from riskframe.functions.expressions import NUMBER_PATTERN
from riskframe.plans import encounters as enc
from riskframe.plans.standins import rounded, sql, table, view
from riskframe.session import new_shared_path
from riskframe.sources import runlog, tables
from riskframe.sources.tables import load_table

QUERIES: dict = {}
ORACLES: dict = {}

ENC_COLUMNS = [
    "encounter_id", "patient_nbr", "race", "gender", "age", "weight", "discharge_disposition_id",
    "admission_type_id", "time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications",
    "number_outpatient", "number_emergency", "number_inpatient", "number_diagnoses", "diag_1", "diag_2",
    "diag_3", "change", "diabetesMed", "A1Cresult", "medical_specialty", "examide", "readmitted",
]
ENC_TEXT = [
    "race", "gender", "age", "weight", "diag_1", "diag_2", "diag_3", "change", "diabetesMed", "A1Cresult",
    "medical_specialty", "examide", "readmitted",
]


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- scans -------------------------------------------------------------------


def scan_profile(spark, d) -> DataFrame:
    rows = load_table(spark, f"{d}/lineitem.parquet", "ingest").where(F.col("l_quantity") >= 25)
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers")
    )


QUERIES["scan_profile"] = scan_profile
ORACLES["scan_profile"] = """
SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers
FROM lineitem WHERE l_quantity >= 25 GROUP BY l_returnflag"""

# --- contract ----------------------------------------------------------------

# The code column is declared as a number, which its prefixed codes are not.
CODE_CONTRACT = Contract(enc.KEY, (ColumnRule("diag_1", "double"), ColumnRule("diag_3", "double", nullable=True)))
PERSON_CONTRACT = Contract(enc.KEY, (*enc.CONTRACT.rules[:1], ColumnRule(enc.GROUP, "bigint", unique=True), *enc.CONTRACT.rules[2:]))


def finding_sql(column: str, check: str, failed: str) -> str:
    return (
        f"SELECT CAST(encounter_id AS VARCHAR) AS row_key, '{column}' AS column_name, '{check}' AS check_name, "
        f"CAST({column} AS VARCHAR) AS failure FROM enc WHERE {failed}"
    )


def rule_sql(rule: ColumnRule) -> list[tuple[str, str]]:
    out = []
    if rule.dtype == "double":
        out.append(("coerce", f"{rule.name} IS NOT NULL AND TRY_CAST({rule.name} AS DOUBLE) IS NULL"))
    if not rule.nullable:
        out.append(("not_null", f"{rule.name} IS NULL"))
    if rule.allowed is not None:
        out.append(("isin", f"{rule.name} NOT IN ({quoted(rule.allowed)})"))
    if rule.at_most is not None:
        out.append(("in_range", f"NOT ({rule.name} BETWEEN {rule.at_least} AND {rule.at_most})"))
    elif rule.at_least is not None:
        out.append(("at_least", f"{rule.name} < {rule.at_least}"))
    if rule.unique:
        out.append(
            ("unique", f"{rule.name} IN (SELECT {rule.name} FROM enc GROUP BY {rule.name} HAVING count(*) > 1)")
        )
    return out


def findings_sql(rules, *checks: str) -> str:
    parts = [
        finding_sql(r.name, check, failed)
        for r in rules
        for check, failed in rule_sql(r)
        if not checks or check in checks
    ]
    return sql(" UNION ALL ".join(parts), "enc")


def row_checks(*checks: str):
    def run(spark, d) -> DataFrame:
        return contract.row_findings(view(spark, d, "enc"), enc.CONTRACT, only=checks)

    return run


QUERIES["contract_coerce"] = lambda spark, d: contract.row_findings(view(spark, d, "enc"), CODE_CONTRACT)
ORACLES["contract_coerce"] = findings_sql(CODE_CONTRACT.rules)
for name, checks in {
    "contract_not_null": ("not_null",),
    "contract_isin": ("isin",),
    "contract_range": ("in_range", "at_least"),
}.items():
    QUERIES[name] = row_checks(*checks)
    ORACLES[name] = findings_sql(enc.CONTRACT.rules, *checks)


def contract_unique(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return contract.duplicate_keys(lines, "l_orderkey", "l_linenumber")


QUERIES["contract_unique"] = contract_unique
ORACLES["contract_unique"] = """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1"""


def contract_unique_rows(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return contract.duplicate_rows(lines, "l_orderkey", "l_linenumber")


QUERIES["contract_unique_rows"] = contract_unique_rows
ORACLES["contract_unique_rows"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
    SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem) WHERE c > 1"""

QUERIES["contract_findings"] = lambda spark, d: contract.contract_findings(view(spark, d, "enc"), PERSON_CONTRACT)
ORACLES["contract_findings"] = findings_sql(PERSON_CONTRACT.rules)

QUERIES["contract_first_findings"] = lambda spark, d: contract.first_findings(
    contract.contract_findings(view(spark, d, "enc"), enc.CONTRACT)
)
ORACLES["contract_first_findings"] = (
    "SELECT * FROM (" + findings_sql(enc.CONTRACT.rules) + ") ORDER BY column_name, check_name, row_key, failure LIMIT 10"
)




def profile_united(spark, d) -> DataFrame:
    """Profiles of the orders by month, stored one by one and united; distinct counts are held against exact ones."""
    orders = table(spark, d, "orders").withColumn("month", F.month("o_orderdate"))
    columns = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    stored = new_shared_path(spark, "profiles")
    for half in (0, 1):  # two deliveries; the second is added without reading the first again
        part = orders.where((F.col("month") > 6).cast("int") == half)
        profile.delivery_profile(part, columns, f"half-{half}").write.mode("append").parquet(stored)
    united = profile.united_profile(spark.read.parquet(stored))
    exact = orders.agg(*[F.count_distinct(c).alias(c) for c in columns]).unpivot([], columns, "column_name", "exact")
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.col("exact") * 4 * 1.04 / 2 ** (profile.SKETCH_BITS / 2)
    return united.join(exact, "column_name").select(
        "column_name", "n_deliveries", "n_rows", "missing_share", near.alias("near")
    )


QUERIES["profile_united"] = profile_united
ORACLES["profile_united"] = """
SELECT unnest(['o_custkey', 'o_orderstatus', 'o_orderpriority']) AS column_name, CAST(2 AS BIGINT) AS n_deliveries,
    count(*) AS n_rows, CAST(0 AS DOUBLE) AS missing_share, true AS near FROM orders"""


def source_round_trip(spark, d) -> DataFrame:
    """Orders delivered as CSV, ingested twice, cleaned of nothing, stored and read back by its stage's name."""
    folder = new_shared_path(spark, "round-trip")
    orders = table(spark, d, "orders")
    tables.write_csv(orders.withColumn("o_orderdate", F.col("o_orderdate").cast("string")), f"{folder}/csv")
    for _ in range(2):  # the second keeps the first's table
        tables.ingest(spark, f"{folder}/csv", f"{folder}/raw", schema=orders.schema)
    raw = tables.load_raw(spark, f"{folder}/raw")
    tables.write_table(raw.where("o_orderstatus <> 'P'"), f"{folder}/clean")
    run = runlog.log_run(spark, f"{folder}/runs", "round_trip", {"source": "csv"}, {"rows": raw.count()})
    logged = runlog.read_runs(spark, f"{folder}/runs").where(F.col("run_id") == run)
    rows = int(logged.where("key = 'rows'").first()["value"])
    return tables.load_clean(spark, f"{folder}/clean", orders.schema).withColumn("logged_rows", F.lit(rows).cast("bigint"))


QUERIES["source_round_trip"] = source_round_trip
ORACLES["source_round_trip"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
    (SELECT count(*) FROM orders) AS logged_rows FROM orders WHERE o_orderstatus <> 'P'"""


def contract_passed(spark, d) -> DataFrame:
    good, _ = contract.split_by_contract(view(spark, d, "enc"), enc.CONTRACT)
    return good.select("encounter_id", "patient_nbr", "age", "time_in_hospital")


QUERIES["contract_passed"] = contract_passed
ORACLES["contract_passed"] = sql(
    "SELECT encounter_id, patient_nbr, age, time_in_hospital FROM enc WHERE "
    + " AND ".join(f"NOT coalesce({failed}, false)" for r in enc.CONTRACT.rules for c, failed in rule_sql(r) if c != "unique"),
    "enc",
)

# --- cleaning ----------------------------------------------------------------

RULES = enc.CLEAN
LEAK = f"(discharge_disposition_id IS NULL OR discharge_disposition_id NOT IN ({', '.join(map(str, RULES.leak_values))}))"
VALID = "gender IS DISTINCT FROM 'Unknown/Invalid'"
TARGET_SQL = "CAST(CASE WHEN readmitted IS NOT DISTINCT FROM '<30' THEN 1 ELSE 0 END AS TINYINT) AS readmitted_30d"


def code_sql(c: str) -> str:
    number = f"CASE WHEN regexp_matches({c}, '{NUMBER_PATTERN}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"
    cases = []
    for group, low, high, included, single in enc.DIAGNOSIS_RANGES:
        test = f"({number}) >= {low} AND ({number}) {'<=' if included else '<'} {high}"
        cases.append(f"WHEN {test}" + (f" OR ({number}) = {single}" if single else "") + f" THEN '{group}'")
    return (
        f"CASE WHEN {c} IS NULL THEN 'Missing' WHEN left({c}, 1) IN ('V', 'E') THEN 'Other' "
        + " ".join(cases)
        + " ELSE 'Other' END"
    )


def nulled(c: str) -> str:
    return f"nullif({c}, '?')" if c in ENC_TEXT else c


QUERIES["clean_sentinel"] = lambda spark, d: clean.replace_missing_token(view(spark, d, "enc"), "?").select(
    enc.KEY, *ENC_TEXT
)
ORACLES["clean_sentinel"] = sql(
    f"SELECT encounter_id, {', '.join(f'{nulled(c)} AS {c}' for c in ENC_TEXT)} FROM enc", "enc"
)
QUERIES["clean_leakage"] = lambda spark, d: clean.drop_leakage(
    view(spark, d, "enc"), RULES.leak_column, RULES.leak_values
).select(enc.KEY, F.col(RULES.leak_column).cast("double").alias(RULES.leak_column))
ORACLES["clean_leakage"] = sql(
    f"SELECT encounter_id, CAST(discharge_disposition_id AS DOUBLE) AS discharge_disposition_id FROM enc WHERE {LEAK}",
    "enc",
)
QUERIES["clean_invalid"] = lambda spark, d: clean.drop_invalid(
    view(spark, d, "enc"), RULES.invalid_column, RULES.invalid_value
).select(enc.KEY, "gender")
ORACLES["clean_invalid"] = sql(f"SELECT encounter_id, gender FROM enc WHERE {VALID}", "enc")
QUERIES["clean_target"] = lambda spark, d: clean.add_binary_target(
    view(spark, d, "enc").select(enc.KEY, "readmitted"), "readmitted", "<30", enc.TARGET
)
ORACLES["clean_target"] = sql(f"SELECT encounter_id, {TARGET_SQL} FROM enc", "enc")
# Whole numbers that can be missing are shown as floating numbers, which both
# engines hand over alike.
GAPS = ["discharge_disposition_id", "num_lab_procedures"]


def clean_full(spark, d) -> DataFrame:
    out = clean.clean(view(spark, d, "enc"), RULES)
    return out.select(*[F.col(c).cast("double").alias(c) if c in GAPS else F.col(c) for c in out.columns])


QUERIES["clean_full"] = clean_full
ORACLES["clean_full"] = sql(
    "SELECT "
    + ", ".join(
        f"{f'CAST({c} AS DOUBLE)' if c in GAPS else nulled(c)} AS {c}"
        for c in ENC_COLUMNS
        if c not in ("weight", "readmitted", *enc.DIAGNOSES)
    )
    + f", {TARGET_SQL}, "
    + ", ".join(f"{code_sql(nulled(c))} AS {c}_group" for c in enc.DIAGNOSES)
    + f" FROM enc WHERE {LEAK} AND {VALID}",
    "enc",
)
QUERIES["clean_metrics"] = lambda spark, d: rounded(clean.clean_metrics(view(spark, d, "enc"), RULES))
ORACLES["clean_metrics"] = sql(
    f"""SELECT count(*) AS rows_in, count(*) FILTER (WHERE {LEAK} AND {VALID}) AS rows_out,
    count(*) FILTER (WHERE NOT {LEAK}) AS leakage_removed,
    round(avg(CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END) FILTER (WHERE {LEAK} AND {VALID}), 6) AS positive_rate
    FROM enc""",
    "enc",
)


def code_group(spark, d) -> DataFrame:
    rows = view(spark, d, "codes").select("l_orderkey", "l_linenumber", "code", F.col("code").alias("raw"))
    grouped = clean.group_codes(
        rows, ["code"], enc.DIAGNOSIS_RANGES, "Other", "Missing", enc.DIAGNOSIS_OTHER_PREFIXES
    )
    return grouped.withColumnRenamed("raw", "code")


QUERIES["code_group"] = code_group
ORACLES["code_group"] = sql(
    f"SELECT l_orderkey, l_linenumber, code, {code_sql('code')} AS code_group FROM codes", "codes"
)
QUERIES["code_group_multi"] = lambda spark, d: clean.group_codes(
    view(spark, d, "enc").select(enc.KEY, *enc.DIAGNOSES),
    enc.DIAGNOSES,
    enc.DIAGNOSIS_RANGES,
    "Other",
    "Missing",
    enc.DIAGNOSIS_OTHER_PREFIXES,
)
ORACLES["code_group_multi"] = sql(
    "SELECT encounter_id, " + ", ".join(f"{code_sql(c)} AS {c}_group" for c in enc.DIAGNOSES) + " FROM enc", "enc"
)


def clean_audit(spark, d) -> DataFrame:
    """Rows and actual rate per subgroup of the cleaned encounters."""
    cleaned = clean.clean(view(spark, d, "enc"), RULES)
    cells = [F.struct(F.lit(a).alias("attribute"), F.col(a).alias("subgroup")) for a in enc.SUBGROUPS]
    out = (
        cleaned.select(enc.TARGET, F.explode(F.array(*cells)).alias("cell"))
        .where("cell.subgroup IS NOT NULL")
        .groupBy("cell.attribute", "cell.subgroup")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(enc.TARGET).alias("actual_rate"))
    )
    return rounded(out)


QUERIES["clean_audit"] = clean_audit
ORACLES["clean_audit"] = sql(
    " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, {nulled(a)} AS subgroup, count(*) AS n, "
        f"round(avg(CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END), 6) AS actual_rate "
        f"FROM enc WHERE {LEAK} AND {VALID} AND {nulled(a)} IS NOT NULL GROUP BY 2"
        for a in enc.SUBGROUPS
    ),
    "enc",
)

# --- profiles ----------------------------------------------------------------

QUERIES["profile_shape"] = lambda spark, d: rounded(profile.table_shape(view(spark, d, "enc"), enc.GROUP))
ORACLES["profile_shape"] = sql(
    f"""SELECT count(*) AS n_rows, {len(ENC_COLUMNS)} AS n_columns, count(DISTINCT patient_nbr) AS n_groups,
    round(count(*) / count(DISTINCT patient_nbr), 6) AS rows_per_group,
    count(*) - count(DISTINCT patient_nbr) AS repeat_rows FROM enc""",
    "enc",
)
QUERIES["profile_value_counts"] = lambda spark, d: profile.value_counts(
    clean.replace_missing_token(view(spark, d, "enc"), "?"), "race"
)
ORACLES["profile_value_counts"] = sql(
    "SELECT nullif(race, '?') AS level, count(*) AS n FROM enc GROUP BY 1 ORDER BY n DESC, level", "enc"
)
QUERIES["profile_pos_rate"] = lambda spark, d: rounded(
    profile.positive_rate(view(spark, d, "enc"), F.col("readmitted") == "<30")
)
ORACLES["profile_pos_rate"] = sql(
    "SELECT round(avg(CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END), 6) AS positive_rate FROM enc", "enc"
)
QUERIES["profile_missing"] = lambda spark, d: rounded(profile.top_missing(view(spark, d, "enc"), "?"))
ORACLES["profile_missing"] = sql(
    "SELECT column_name, round(missing_share, 6) AS missing_share FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, avg(CASE WHEN {nulled(c)} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_share FROM enc"
        for c in ENC_COLUMNS
    )
    + ") WHERE missing_share > 0 ORDER BY missing_share DESC, column_name LIMIT 12",
    "enc",
)
