import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators.contract import ColumnRule, Contract, unique_findings
from riskframe.streaming import streams, unique

SCHEMA = "ts timestamp_ntz, k long, c string, v double"


def deliver(spark, path, rows):
    """One file per call; files are read in this order."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, delay="1 hour"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return streams.event_time(stream, "ts", delay)


def row(hour, k=0, c="a", v=0.0, day=1):
    return (pd.Timestamp(2024, 1, day, hour).to_pydatetime(), k, c, v)


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(unique.PROVIDER)
    unique.use_rocks_state(spark)
    yield
    spark.conf.set(unique.PROVIDER, before)


def run_unique(spark, path, out, delay, ttl_ms):
    contract = Contract("k", [ColumnRule("c", "string", unique=True), ColumnRule("k", "bigint")])
    found = unique.unique_stream(source(spark, path, delay), contract, "ts", ttl_ms)
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
    query.trigger(availableNow=True).start().awaitTermination(120)
    schema = "row_key string, column_name string, check_name string, failure string"
    return contract, sorted(tuple(r) for r in spark.read.schema(schema).parquet(out).collect())


def test_repeats_over_batches_equal_the_batch_findings(spark, tmp_path, rocks):
    path = str(tmp_path / "in")
    deliver(spark, path, [row(0, 1, "x"), row(0, 2, "y"), row(1, 3, "x"), row(1, 9, None)])
    deliver(spark, path, [row(1, 4, "y"), row(1, 5, "z"), row(1, 6, "x"), row(1, 10, None)])
    contract, got = run_unique(spark, path, str(tmp_path / "out"), "2 days", 10**9)
    want = unique_findings(spark.read.parquet(path), contract)
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) == 5


def test_all_rows_are_compared_by_default(spark, tmp_path, rocks):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    old = (pd.Timestamp(1950, 1, 1).to_pydatetime(), 8, "old", 0.0)
    deliver(spark, path, [row(0, 1, "x"), row(0, 2, "y"), old, (None, 9, "no time", 0.0)])
    deliver(spark, path, [row(0, 3, "z", day=28)])  # the watermark passes all before
    deliver(spark, path, [row(0, 4, "x", day=29), row(0, 5, "y"), (old[0], 6, "old", 0.0), (None, 7, "no time", 0.0)])
    contract = Contract("k", [ColumnRule("c", "string", unique=True)])
    found = unique.unique_stream(source(spark, path, "1 hour"), contract, "ts")
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
    query.trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.schema("row_key string, column_name string, check_name string, failure string").parquet(out).collect()
    want = unique_findings(spark.read.parquet(path), contract).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 8


def test_keys_are_forgotten_after_their_time(spark, tmp_path, rocks):
    path = str(tmp_path / "in")
    deliver(spark, path, [row(0, 1, "x"), row(0, 2, "y")])
    deliver(spark, path, [row(0, 3, "late", day=3)])  # the watermark passes x and y
    deliver(spark, path, [row(1, 4, "x", day=3), row(1, 5, "late", day=3)])
    _, got = run_unique(spark, path, str(tmp_path / "out"), "1 hour", 3_600_000)
    assert got == [("3", "c", "unique", "late"), ("5", "c", "unique", "late")]


def test_a_bucket_forgets_some_values_and_keeps_the_others(spark, tmp_path, rocks):
    path = str(tmp_path / "in")
    deliver(spark, path, [row(0, 1, "x"), row(0, 2, "y"), row(9, 3, "kept"), row(9, 4, "kept too")])
    deliver(spark, path, [row(11, 5, "late")])  # the watermark passes x and y
    deliver(spark, path, [row(10, 6, "kept too"), row(11, 7, "x")])
    contract = Contract("k", [ColumnRule("c", "string", unique=True)])
    out = str(tmp_path / "out")
    found = unique.unique_stream(source(spark, path, "1 hour"), contract, "ts", 5 * 3_600_000, buckets=1)
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
    query.trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.schema("row_key string, column_name string, check_name string, failure string").parquet(out).collect()
    assert sorted((r.row_key, r.failure) for r in got) == [("4", "kept too"), ("6", "kept too")]


def test_calls_and_state_are_by_bucket_not_by_value(spark, tmp_path, rocks):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, path, [row(0, k, f"v{k}") for k in range(400)] + [row(0, k, "hot") for k in range(400, 500)])
    deliver(spark, path, [row(1, 1000 + k, f"v{k}") for k in range(0, 400, 3)] + [row(1, 2000, "hot"), row(1, 2001, "new")])
    contract = Contract("k", [ColumnRule("c", "string", unique=True), ColumnRule("k", "bigint")])
    found = unique.unique_stream(source(spark, path, "2 days"), contract, "ts", 10**9, buckets=8)
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
    query = query.trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.schema("row_key string, column_name string, check_name string, failure string").parquet(out)
    want = unique_findings(spark.read.parquet(path), contract)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 0 < max(streams.open_rows(query)) <= 8 * 3  # a bucket's values and timers; not 402 values


def test_windows_close_once_and_leave_the_state(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [row(h, h, "ab"[h % 2], float(h)) for h in range(0, 20)]
    deliver(spark, path, first)
    deliver(spark, path, [row(2, 1, "a", 5.0, day=2)])
    deliver(spark, path, [row(3, 1, "a", 5.0, day=2), row(5, 7, "late", 1.0)])
    counts = streams.window_counts(source(spark, path), "ts", ["c"], "6 hours")
    query = streams.run_closed(counts, streams.write_closed(out), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(out).select(F.col("window_start").cast("string").alias("s"), "level", "n").collect()
    want = {(f"2024-01-01 {h:02d}:00:00", c): n for h in (0, 6, 12) for c, n in (("a", 3), ("b", 3))}
    want |= {("2024-01-01 18:00:00", "a"): 1, ("2024-01-01 18:00:00", "b"): 1}
    assert {(r.s, r.level): r.n for r in got} == want and len(got) == len(want)
    assert streams.late_rows(query) == 1
    held = streams.open_rows(query)
    assert max(held) >= 7 and held[-1] == 1  # only the open window is kept
    # A batch that is run again replaces its own window only.
    write = streams.write_closed(out)
    again = spark.createDataFrame([("c", "a", 9, pd.Timestamp(2024, 1, 1, 6).to_pydatetime())], "column_name string, level string, n long, window_start timestamp")
    write(again, 1)
    write(again, 1)
    assert spark.read.parquet(out).count() == len(want) - 1


def exact(reference, current):
    r, c = np.sort(reference), np.sort(current)
    x = np.unique(np.concatenate([r, c]))
    gap = np.abs(np.searchsorted(r, x, side="right") / len(r) - np.searchsorted(c, x, side="right") / len(c))
    return gap.max(), (gap[:-1] * np.diff(x)).sum() / max(r.std(), 0.001)


def test_sketch_distances_stay_within_their_bounds(spark, tmp_path):
    rng = np.random.default_rng(1)
    reference = rng.gamma(2.0, 3.0, 30_000)
    days = {1: rng.gamma(2.0, 3.3, 9_000), 2: rng.normal(6.0, 2.0, 7_000), 3: np.repeat([1.0, 2.0], 50), 4: np.array([4.5])}
    rows = [(pd.Timestamp(2024, 1, d, 5), "v", float(v)) for d, values in days.items() for v in values]
    known = streams.reference_sketches(spark.createDataFrame(pd.DataFrame({"v": reference})), ["v"])
    frame = pd.DataFrame([(t, v) for t, _, v in rows], columns=["ts", "v"])
    windows = streams.window_sketches(spark.createDataFrame(frame), "ts", ["v"], "1 day")
    got = {r.window_start.day: r for r in streams.sketch_drift(windows, known).collect()}
    assert set(got) == set(days)
    for day, values in days.items():
        ks, distance = exact(reference, values)
        assert got[day].rows == len(values)
        assert abs(got[day].ks - ks) <= got[day].ks_bound
        assert abs(got[day].wasserstein - distance) <= got[day].wasserstein_bound
    assert got[2].drifted and got[1].ks_bound < 0.05
    # United sketches stand for the united rows.
    union = streams.merge_windows(windows.where(F.dayofmonth("window_start") <= 2).withColumn("all", F.lit(1)), "all")
    whole = streams.sketch_drift(union.withColumnRenamed("all", "window_start"), known).first()
    ks, _ = exact(reference, np.concatenate([days[1], days[2]]))
    assert whole.rows == 16_000 and abs(whole.ks - ks) <= whole.ks_bound


def test_stream_numeric_drift_is_within_the_bound_of_sql(spark):
    from riskframe.plans import catalog
    from riskframe.plans.standins import sql

    folder = "/root/testdata/sf0.001"
    found = catalog.QUERIES["stream_numeric_drift"](spark, folder).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    reference = con.execute(sql("SELECT * FROM ref", "ref")).df()
    days = con.execute("SELECT date_trunc('day', ts) AS day, value, user_id FROM events").df()
    closed = con.execute("""SELECT count(DISTINCT date_trunc('day', ts)) FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""").fetchone()[0]
    assert len(found) == 2 * closed > 0
    for r in found.itertuples():
        ks, distance = exact(reference[r.column_name].to_numpy(float), days.loc[days["day"] == r.window_start, r.column_name].to_numpy(float))
        assert abs(r.ks - ks) <= r.ks_bound and abs(r.wasserstein - distance) <= r.wasserstein_bound
