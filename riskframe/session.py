"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "riskframe", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.scheduler.mode": "FAIR",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session without executors (``local[n]``, as in tests) may leave it unset
    and gets a temporary folder; any other must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="riskframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the session's own folder, which goes when its JVM ends."""
    own = f"{shared_dir(spark)}/riskframe-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> str:
    """Write ``df`` to a new folder under the shared one; returns its path."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the optimizer
    the table's true size for its join choices.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


#: Tasks of ``together`` that submit jobs at the same time.
SIDE_BY_SIDE = 8


def together(spark: SparkSession, tasks: Sequence[Callable], most: int = SIDE_BY_SIDE) -> list:
    """Results of tasks that run Spark jobs side by side, each in a scheduler pool of its own.

    Tasks started from within a task share its pool's threads' settings, not its pool.
    """
    if len(tasks) == 1:
        return [tasks[0]()]
    context = spark.sparkContext

    def run(number: int):
        context.setLocalProperty("spark.scheduler.pool", f"together-{number}")
        try:
            return tasks[number]()
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(min(most, len(tasks))) as threads:
        return list(threads.map(inheritable_thread_target(spark)(run), range(len(tasks))))
