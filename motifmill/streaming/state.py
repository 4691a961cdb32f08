"""Streams that remember: the first row of each key across batches, and running token counts.

The first row is kept by a keyed state with a timer (``transformWithState``): a key's row goes out
once, when the key is first seen; of rows that arrive together the one with the least order is
taken.  With ``forget`` a key's state is dropped that long after it was last seen, so state stays
bounded on endless streams.  Files that are read to their end need no such state: the rows that went
out before are joined with each batch.  Counts are a streaming aggregation whose updates are folded into a
table, so that a restart repeats no batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from motifmill.operators.clean import keep_first
from motifmill.scratch import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstRow(StatefulProcessor):
    """Lets the first row of each key through; ``forget`` is in milliseconds, 0 keeps keys for good."""

    def __init__(self, order: str, forget: int = 0):
        self.order, self.forget = order, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        best = None
        for pdf in rows:
            own = pdf.sort_values(self.order, kind="stable").head(1)
            if best is None or own[self.order].iloc[0] < best[self.order].iloc[0]:
                best = own
        if self.forget:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget)
        if best is not None and not self.seen.exists():
            self.seen.update((True,))
            yield best

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_rows(stream: DataFrame, key: str, order: str, forget: int = 0) -> DataFrame:
    """The first row of each key of a stream, in the columns it has."""
    return stream.groupBy(key).transformWithStateInPandas(FirstRow(order, forget), stream.schema, "Append", "ProcessingTime" if forget else "None")


@contextmanager
def state_store(spark: SparkSession, partitions: int):
    """State in RocksDB, in so many partitions, for the streams that start inside."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(partitions)}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now and appends its rows to a Parquet folder."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        # A batch that is repeated after a failure replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", shared_folder(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def first_rows_of_files(spark: SparkSession, folder: str, schema, key: str, order: str, path: str, partitions: int = 8, files: int = 4) -> None:
    """The first row of each key of Parquet files, taken ``files`` to a batch as they arrived.

    What went out before is the state: a batch is reduced to one row a key, in its tasks first, and the
    keys of earlier batches leave.  No key is called for by itself, as a keyed state in Python would.
    """
    seen = spark.read.schema(StructType([*stream_schema(schema).fields, StructField("batch", LongType())]))

    def put(batch: DataFrame, number: int) -> None:
        first = keep_first(batch, key, order)
        if number:
            # Only earlier batches count, so that one repeated after a failure gives the same rows.
            earlier = seen.parquet(path).where(F.col("batch") < number).select(F.col(key).alias("_seen"))
            first = first.join(earlier, F.col(key).eqNullSafe(F.col("_seen")), "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_store(spark, partitions):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", shared_folder(spark, "stream")).trigger(availableNow=True).start()
        query.awaitTermination()


def stream_schema(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def running_counts(spark: SparkSession, stream: DataFrame, token: str, path: str, partitions: int = 8) -> DataFrame:
    """(token, freq) of all rows of a stream so far: the last update of each token."""
    with state_store(spark, partitions):
        run_to_end(stream.groupBy(token).agg(F.count(F.lit(1)).alias("freq")), path, "update")
    seen = spark.read.schema(f"`{token}` string, freq bigint, batch int").parquet(path)
    return seen.groupBy(token).agg(F.max("freq").alias("freq"))
