"""Table sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from riskframe.functions.expressions import nan_to_null


def load_table(spark: SparkSession, path: str, stage: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A Parquet table; a missing one names the stage that writes it."""
    try:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no table at {path}: run the {stage} stage first") from error
        raise


def load_raw(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return load_table(spark, path, "ingest", schema)


def load_clean(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return load_table(spark, path, "clean", schema)


def read_external(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None) -> DataFrame:
    """The delivered table with all its columns, identifiers included.

    CSV without a schema is read as text; the contract's coercion types it.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def ingest(
    spark: SparkSession,
    source: str,
    out: str,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    force: bool = False,
) -> str:
    """Store the delivered table as Parquet; an existing table is kept unless forced."""
    df = nan_to_null(read_external(spark, source, fmt, schema))
    write_table(df, out, "overwrite" if force else "ignore")
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
