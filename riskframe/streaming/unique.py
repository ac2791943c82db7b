"""Uniqueness findings on a stream, with state per value, kept together by bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskframe.operators.contract import FINDINGS_SCHEMA, Contract

#: Parts of a column's values by hash: a batch costs a call per part, not one per value.
BUCKETS = 8_192
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

HELD = pa.schema([("value", pa.string()), ("row_key", pa.string()), ("reported", pa.bool_()), ("lapses", pa.int64())])


def _packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as out:
        out.write_table(pa.Table.from_pandas(held, HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class FirstSighting(StatefulProcessor):
    """Remembers the row that brought a value first, and whether it was reported.

    The first row is reported when the value is seen again, later ones at once, so
    the findings are those of the batch check over all rows, or, if a time to live
    is given, over the rows within it. A call gets the rows of one bucket of values;
    its state is one small row per value.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "packed binary, wakes bigint")

    def _load(self, timerValues) -> tuple[pd.DataFrame, int | None]:
        """The values within their time, and when the bucket's timer wakes."""
        packed, wakes = self.held.get() or (None, None)
        held = _unpacked(packed) if packed is not None else HELD.empty_table().to_pandas()
        if self.ttl_ms is None:
            return held, None
        return held[held["lapses"] > timerValues.getCurrentWatermarkInMs()].reset_index(drop=True), wakes

    def _keep(self, held: pd.DataFrame, wakes: int | None) -> None:
        if self.ttl_ms is None:
            self.held.update((_packed(held), None))
            return
        # A timer may wake before anything lapses, as values are seen again; it is set anew then.
        earliest = int(held["lapses"].min())
        if wakes is None or earliest < wakes:
            self.handle.registerTimer(earliest)
            wakes = earliest
        self.held.update((_packed(held), wakes))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows come before the timers of their batch, so lapsed values may still be there.
        held, wakes = self._load(timerValues)
        for part in rows:
            values = part["value"]
            fresh = ~(values.isin(held["value"]) | values.duplicated()).to_numpy()
            if fresh.any():
                new = part.loc[fresh, ["value", "row_key"]].assign(reported=False, lapses=np.int64(0))
                held = pd.concat([held, new], ignore_index=True) if len(held) else new.reset_index(drop=True)
            place = pd.Index(held["value"]).get_indexer(values)
            reported, lapses = held["reported"].to_numpy(bool, copy=True), held["lapses"].to_numpy(np.int64, copy=True)
            if self.ttl_ms is not None:
                np.maximum.at(lapses, place, part["at_ms"].fillna(0).to_numpy(np.int64) + self.ttl_ms)
            again = np.unique(place[~fresh])
            first = held.loc[again[~reported[again]], ["value", "row_key"]]
            reported[again] = True
            held = held.assign(reported=reported, lapses=lapses)
            found = pd.concat([first, part.loc[~fresh, ["value", "row_key"]]], ignore_index=True)
            if len(found):
                yield pd.DataFrame(
                    {"row_key": found["row_key"], "column_name": key[0], "check_name": "unique", "failure": found["value"]}
                )
        self._keep(held, wakes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._load(timerValues)
        if len(held):
            self._keep(held, None)
        else:
            self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def unique_stream(
    stream: DataFrame, contract: Contract, time: str, ttl_ms: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Findings of the contract's unique columns: row_key, column_name, check_name, failure.

    All rows are compared, however far apart or late they come; state is one
    small row per value. Only a caller that gives ``ttl_ms`` has values forgotten
    when the watermark of the column ``time`` is so far past their last sighting,
    and rows behind the watermark left out. ``buckets`` of values are kept
    together per column; the number must stay as it is for a checkpoint. The
    session must keep state in RocksDB (``use_rocks_state``).
    """
    columns = [r.name for r in contract.rules if r.unique and r.name in stream.columns]
    if not columns:
        raise ValueError("the contract has no unique column that the stream holds")
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    row_key, at_ms = F.col(contract.key).cast("string").alias("row_key"), F.unix_millis(time).alias("at_ms")
    # A column with a watermark would have its late rows dropped.
    times, mode = ([], "None") if ttl_ms is None else ([F.col(time), at_ms], "EventTime")
    rows = stream.select(*times, row_key, F.explode(F.array(*cells)).alias("c"))
    known = rows.select("*", "c.*").drop("c").where(F.col("value").isNotNull())
    keyed = known.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int")).groupBy("column_name", "bucket")
    return keyed.transformWithStateInPandas(FirstSighting(ttl_ms), FINDINGS_SCHEMA, "Append", mode)


def use_rocks_state(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB."""
    spark.conf.set(PROVIDER, ROCKS)
