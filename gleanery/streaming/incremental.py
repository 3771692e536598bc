"""Runs as a stream: listings arrive, those of known identity are dropped, and the key table grows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import history
from ..session import exists


def first_seen(stream: DataFrame, key: str, ts: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key; with a time column, keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]) if ts else stream.dropDuplicates([key])


class Remembering(StatefulProcessor):
    """Keeps for each key when it came last, and lets the first row through. A timer forgets the key once the watermark is `ttl_ms` past that time; with
    `renew`, each later row moves the timer, so only keys that stay away are forgotten."""

    def __init__(self, columns: list[str], ts: str, ttl_ms: int, renew: bool):
        self.columns, self.ts, self.ttl, self.renew = columns, ts, ttl_ms, renew

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", StructType([StructField("ms", LongType())]))

    def _keep(self, until: int) -> None:
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        self.until.update((until,))
        self.handle.registerTimer(until)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, last = None, 0
        for row in rows:
            first = row if first is None or row[self.ts] < first[self.ts] else first
            last = max(last, int(row[self.ts].timestamp() * 1000))
        if not self.until.exists():
            self._keep(last + self.ttl)
            yield Row(**{c: first[c] for c in self.columns})
        elif self.renew and last + self.ttl > self.until.get()[0]:
            self._keep(last + self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        """Nothing is held beside the state."""


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that remembered() needs: keys are on the executors' disks, not in their heaps. For applications, not for operators."""
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def remembered(stream: DataFrame, keys: list[str], ts: str, ttl_seconds: float, late: str = "1 day", renew: bool = False) -> DataFrame:
    """The earliest row of each key in the batch that brings it, as keyed state that expires by the rows' own times, in place of a join with a
    table of all keys ever seen. A key that comes after its time counts as new; a null key is one like others; rows later than `late` are dropped."""
    marked = stream.withWatermark(ts, late)
    return marked.groupBy(*keys).transformWithState(statefulProcessor=Remembering(stream.columns, ts, int(ttl_seconds * 1000), renew), outputStructType=stream.schema, outputMode="Append", timeMode="EventTime")


def new_listings(stream: DataFrame, keys: Column, row_id: str, history_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Each batch is held against the key table, written under its batch number, and its keys appended last. A batch that runs
    again overwrites itself, since keys of its own number don't count as seen."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = exists(spark, history_path)
        seen = spark.read.parquet(history_path).where(F.col("batch") < number) if known else spark.createDataFrame([], "key string, batch long")
        fresh = history.not_seen(batch, keys, seen, row_id).persist()
        fresh.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        added = history.new_keys(fresh.select(F.explode(keys).alias("key")), seen)
        added.write.mode("overwrite").parquet(f"{history_path}/batch={number}")
        fresh.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, size: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"))
