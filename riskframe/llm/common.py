"""What the operators of this package share: tables, folds, words and Arrow steps.

Every operator reads the columns named by its parameters and no others, so
further columns, also of clashing names, never disturb it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
LOWER_CASE = bytes.maketrans(UPPER, LOWER)

#: Rows and bytes of an Arrow batch that a step gets at once (or one row).
SLICE_ROWS, SLICE_BYTES = 10_000, 8 << 20

# A step gets the input columns of a slice of an Arrow batch and returns (rows, columns):
# the input row of each output row (None: one output row per input row, in order).
Step = Callable[..., tuple["pa.Array | None", Sequence[pa.Array]]]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_fold(doc_id: str, remainder: int) -> Column:
    """Whether crc32 of the id as text, modulo 5, is ``remainder``; no id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(quoted(doc_id).cast("string")), F.lit(5)) == remainder, F.lit(False))


def whole_bytes(text: str) -> Column:
    """The text's UTF-8 bytes; a missing text has none."""
    return F.coalesce(quoted(text), F.lit("")).cast("binary")


def ascii_words(data: bytes) -> list[bytes]:
    """Runs of bytes other than blank, tab, line feed, vertical tab, form feed and
    carriage return, A-Z in lower case; other letters stay as they are."""
    return data.translate(LOWER_CASE).split()


def map_batches(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[Column],
    result: str,
    make: Callable[[], Step],
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The kept columns and the results of a step over Arrow batches.

    ``make`` builds the step once per task. Memory holds one batch (at most
    ``spark.sql.execution.arrow.maxBytesPerBatch``, or one row) and the results
    of one slice of it.
    """
    n = len(keep)
    rows = df.select(
        *[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], *[e.alias(f"i{i}") for i, e in enumerate(inputs)]
    )
    fields = [T.StructField(f"k{i}", df.schema[c].dataType, True) for i, c in enumerate(keep)]
    added = T.StructType.fromDDL(result) if isinstance(result, str) else result
    fields += [T.StructField(f"r{i}", f.dataType, True) for i, f in enumerate(added)]
    names = [f.name for f in fields]

    def run(batches):
        step = None
        for batch in batches:
            if not batch.num_rows:
                continue
            step = step or make()
            height = max(1, min(SLICE_ROWS, batch.num_rows * slice_bytes // max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, height):
                part = batch.slice(first, height)
                index, columns = step(*part.columns[n:])
                kept = part.columns[:n]
                if index is not None:
                    kept = [c.take(index) for c in kept]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=names)

    return rows.mapInArrow(run, T.StructType(fields)).toDF(*keep, *added.names)


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without gaps, and where each value starts and the last one ends."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype="<i8" if wide else "<i4")[column.offset : column.offset + len(column) + 1]
    places = places.astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def with_number(df: DataFrame, name: str) -> DataFrame:
    """Number the rows; write the result before it is read twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def slots(df: DataFrame, group: str, number: str, name: str, order: Sequence[str] = (), parts: int = 256) -> DataFrame:
    """A gapless number from 0 for the rows of each group, in order of a hashed part.

    ``df`` must be a written table whose ``number`` differs from row to row. A
    group is split into ``parts`` by that number, so no task holds a large
    group; each part's rows are counted, the counts of the parts before it are
    added (one row per group and part), and rows are numbered inside a part.
    """
    from pyspark.sql import Window

    placed = df.withColumn("_part", F.pmod(F.xxhash64(number), F.lit(parts)))
    counts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_part").orderBy(*order, number)
    return (
        placed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(before, [group, "_part"])
        .withColumn(name, (F.col("_row") + F.col("_before")).cast("bigint"))
        .drop("_part", "_row", "_before")
    )


def int_list(values: Sequence[Sequence[int]], kind: pa.DataType = pa.int32()) -> pa.Array:
    return pa.array(values, type=pa.list_(kind))


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.select(*[quoted(c).alias(n) for c, n in names.items()])


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
