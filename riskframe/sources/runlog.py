"""Append-only log of parameters and metrics per named run."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "run_id string, run_name string, kind string, key string, value string, ts timestamp"


def log_run(
    spark: SparkSession, path: str, name: str, params: Mapping | None = None, metrics: Mapping | None = None
) -> str:
    """Add one run's few entries to the log; returns the run's id."""
    run, now = uuid.uuid4().hex, datetime.now(timezone.utc)
    rows = [
        (run, name, kind, str(key), str(value), now)
        for kind, entries in (("param", params), ("metric", metrics))
        for key, value in (entries or {}).items()
    ]
    if rows:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return run


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
