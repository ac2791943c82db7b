import pytest
from pyspark.sql import functions as F

from riskframe.functions import expressions as ex
from riskframe.operators import clean, profile
from riskframe.plans import encounters as enc


def test_binary_target(spark):
    df = spark.createDataFrame([("<30",), (">30",), ("NO",), (None,)], "readmitted string")
    out = clean.add_binary_target(df, "readmitted", "<30", "y")
    assert [r.y for r in out.collect()] == [1, 0, 0, 0]
    assert out.columns == ["y"] and out.dtypes == [("y", "tinyint")]


def test_terminal_dispositions_go_and_missing_stay(spark):
    df = spark.createDataFrame([(1,), (11,), (13,), (3,), (14,), (None,)], "d int")
    assert [r.d for r in clean.drop_leakage(df, "d", enc.TERMINAL_DISPOSITIONS).collect()] == [1, 3, None]


def test_invalid_value_goes_and_missing_stays(spark):
    df = spark.createDataFrame([("Male",), ("Unknown/Invalid",), (None,)], "g string")
    assert [r.g for r in clean.drop_invalid(df, "g", "Unknown/Invalid").collect()] == ["Male", None]


CODES = {
    "250.83": "Diabetes",
    "250": "Diabetes",
    "251": "Other",
    "428": "Circulatory",
    "785": "Circulatory",
    "785.1": "Other",
    "459.5": "Other",
    "486": "Respiratory",
    "786": "Respiratory",
    "530": "Digestive",
    "787": "Digestive",
    "999": "Injury",
    "715": "Musculoskeletal",
    "788": "Genitourinary",
    "140": "Neoplasms",
    "V45": "Other",
    "E909": "Other",
    "250d": "Other",
    "0x1p3": "Other",
    "abc": "Other",
    "": "Other",
    " 428 ": "Circulatory",
    "4.28e2": "Circulatory",
    None: "Missing",
}


def test_code_groups(spark):
    df = spark.createDataFrame([(c,) for c in CODES], "code string")
    group = ex.grouped_code("code", enc.DIAGNOSIS_RANGES, "Other", "Missing", enc.DIAGNOSIS_OTHER_PREFIXES)
    assert {r.code: r.g for r in df.select("code", group.alias("g")).collect()} == CODES


def encounters(spark):
    return spark.createDataFrame(
        [
            (1, "Male", "250.5", "?", "V45", "?", "<30"),
            (11, "Female", "428", "486", "?", "[50-75)", "NO"),
            (1, "Unknown/Invalid", "428", "486", "?", "?", "NO"),
        ],
        "discharge_disposition_id int, gender string, diag_1 string, diag_2 string, diag_3 string, weight string, "
        "readmitted string",
    )


def test_clean_end_to_end(spark):
    rows = clean.clean(encounters(spark), enc.CLEAN).collect()
    assert len(rows) == 1
    row = rows[0].asDict()
    assert row["readmitted_30d"] == 1
    assert (row["diag_1_group"], row["diag_2_group"], row["diag_3_group"]) == ("Diabetes", "Missing", "Other")
    assert not {"weight", "diag_1", "readmitted"} & set(row)


def test_clean_without_the_dropped_column(spark):
    assert clean.clean(encounters(spark).drop("weight"), enc.CLEAN).count() == 1


def test_clean_metrics(spark):
    row = clean.clean_metrics(encounters(spark), enc.CLEAN).first()
    assert row.asDict() == {"rows_in": 3, "rows_out": 1, "leakage_removed": 1, "positive_rate": 1.0}


def test_clean_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "raw")
    encounters(spark).write.parquet(path)
    plan = clean.clean(spark.read.parquet(path), enc.CLEAN)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(discharge_disposition_id)" in plan
    assert "Exchange" not in plan


def test_sentinel_is_a_whole_cell(spark):
    df = spark.createDataFrame([("?", 1), ("a?", 2)], "t string, n int")
    assert [tuple(r) for r in clean.replace_missing_token(df, "?").collect()] == [(None, 1), ("a?", 2)]


@pytest.mark.parametrize("text, number", [("1_0", None), ("1.", 1.0), (".5", 0.5), ("1d", None), ("nan", None)])
def test_text_number(spark, text, number):
    assert spark.range(1).select(ex.text_number(F.lit(text))).first()[0] == number


def test_next_level_stops_at_the_last_and_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("c",), (None,), ("z",)], "v string")
    assert [r[0] for r in df.select(ex.next_level("v", ["a", "b", "c"])).collect()] == ["b", "c", None, "z"]


def test_profiles(spark):
    df = spark.createDataFrame(
        [(1, "?", 1.0), (1, "a", float("nan")), (2, None, 2.0), (3, "a", 3.0)], "g long, t string, x double"
    )
    shape = profile.table_shape(df, "g").first()
    assert (shape.n_rows, shape.n_columns, shape.n_groups, shape.repeat_rows) == (4, 3, 3, 1)
    assert [(r.level, r.n) for r in profile.value_counts(df, "t").collect()] == [("a", 2), ("?", 1), (None, 1)]
    assert profile.positive_rate(df, F.col("t") == "a").first()[0] == 0.5
    assert [(r[0], r[1]) for r in profile.top_missing(df, "?").collect()] == [("t", 0.5), ("x", 0.25)]
    assert ex.nan_to_null(df).where("x IS NULL").count() == 1
