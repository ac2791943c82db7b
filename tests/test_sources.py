import pytest
from pyspark.sql import functions as F

from riskframe.plans.encounters import CONTRACT
from riskframe.sources import runlog, tables
from riskframe.streaming import streams
from tests.data import raw


def test_missing_table_names_its_stage(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="ingest"):
        tables.load_raw(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError, match="clean"):
        tables.load_clean(spark, str(tmp_path / "none"))


def test_ingest_keeps_an_existing_table_unless_forced(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a")], "id int, v string").write.csv(source, header=True)
    tables.ingest(spark, source, out)
    spark.createDataFrame([(2, "b"), (3, None)], "id int, v string").write.mode("overwrite").csv(source, header=True)
    tables.ingest(spark, source, out)
    assert [r.id for r in spark.read.parquet(out).collect()] == ["1"]
    tables.ingest(spark, source, out, schema="id int, v string", force=True)
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [(2, "b"), (3, None)]


def test_ingest_turns_nan_into_missing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1.0,), (float("nan"),)], "x double").write.parquet(source)
    tables.ingest(spark, source, out, fmt="parquet")
    assert spark.read.parquet(out).where("x IS NULL").count() == 1


def test_scan_reads_only_used_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    raw(spark, {}).write.parquet(path)
    df = tables.load_raw(spark, path).where("time_in_hospital > 2").select("encounter_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<encounter_id:bigint,time_in_hospital:int>" in plan
    assert "GreaterThan(time_in_hospital,2)" in plan


def test_csv_sink_has_a_header(spark, tmp_path):
    path = str(tmp_path / "c")
    tables.write_csv(spark.createDataFrame([("gender", "F", 3)], "attribute string, subgroup string, n int"), path)
    assert spark.read.csv(path, header=True).columns == ["attribute", "subgroup", "n"]


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "runs")
    a = runlog.log_run(spark, path, "one", {"model": "x"}, {"auc": 0.5})
    b = runlog.log_run(spark, path, "two", metrics={"auc": 0.75})
    rows = {(r.run_id, r.kind, r.key): r.value for r in runlog.read_runs(spark, path).collect()}
    assert rows == {(a, "param", "model"): "x", (a, "metric", "auc"): "0.5", (b, "metric", "auc"): "0.75"}


def test_contract_stream_sets_findings_aside(spark, tmp_path):
    source, good, bad = (str(tmp_path / n) for n in ("in", "good", "bad"))
    raw(spark, {}, {"encounter_id": 2, "gender": "X"}, {"encounter_id": 3, "age": None}).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    streams.check_stream(stream, CONTRACT, good, bad, str(tmp_path / "ck")).awaitTermination(120)
    assert [r.encounter_id for r in spark.read.parquet(good).collect()] == [1]
    assert sorted((r.row_key, r.column_name) for r in spark.read.parquet(bad).collect()) == [("2", "gender"), ("3", "age")]


def test_a_batch_run_again_replaces_its_rows(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    write = streams.write_checked(CONTRACT, good, bad)
    for _ in range(2):
        write(raw(spark, {}), 7)
    assert spark.read.parquet(good).count() == 1


def test_repeated_keys_leave_the_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "k long, t string").select("k", F.col("t").cast("timestamp_ntz").alias("ts"))
    df.coalesce(1).write.parquet(source)
    stream = streams.event_time(spark.readStream.schema(df.schema).parquet(source), "ts", "1 hour")
    query = (
        streams.unique_keys(stream, "k").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def add(*rows):
        df = spark.createDataFrame(rows, "t string, c string")
        df.select(F.col("t").cast("timestamp_ntz").alias("ts"), "c").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = streams.event_time(spark.readStream.schema("ts timestamp_ntz, c string").parquet(source), "ts", "1 hour")
        query = (
            streams.window_counts(stream, "ts", ["c"], "1 hour").writeStream.outputMode("append").format("parquet")
            .option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)

    add(("2024-01-01 00:10:00", "a"), ("2024-01-01 05:00:00", "a"))
    run()
    add(("2024-01-01 00:20:00", "a"), ("2024-01-01 09:00:00", "a"))
    run()
    rows = {str(r.window_start): r.n for r in spark.read.parquet(out).collect()}
    assert rows["2024-01-01 00:00:00"] == 1


def test_window_drift_counts_absent_levels(spark):
    import math

    shares = streams.reference_shares(spark.createDataFrame([("a",), ("b",)], "c string"), ["c"])
    counts = spark.createDataFrame([("w", "c", "a", 10)], "window_start string, column_name string, level string, n long")
    got = streams.window_drift(counts, shares).first()
    js = (0.5 * math.log(0.5 / 0.75) + math.log(1 / 0.75) + 0.5 * math.log(2)) / 2
    assert abs(got.js_distance - math.sqrt(js)) < 1e-12 and got.drifted
