"""One evolving gap for each dedupe key, kept as state of a stream: a finding creates it or updates it, and silence makes it stale.

A finding that is older than what the gap shows never overwrites its measurement; it only widens its span. So the state depends
on the findings and not on how they fall into micro-batches, and equals the batch upsert over them. A gap without a finding for
``stale_seconds`` has its timer expire when the watermark passes that time, and is stale until the next finding.

Edge cases: repeated findings of one run are updates, the last ordinal's measurement counts; a null measurement is one; rows without
a time or later than the watermark are dropped by the engine, so the watermark must lie further back than deliveries can.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "first_seen long, last_seen long, ordinal long, updates long, observed double, stale boolean, sequence long"
CHANGE = "dedupe_key string, change string, first_seen long, last_seen long, updates long, observed double, stale boolean, sequence long"
CHANGED = Row(*(field.split()[0] for field in CHANGE.split(", ")))
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EvolvingGap(StatefulProcessor):
    """Times are microseconds."""

    def __init__(self, stale_after: int):
        self.stale_after = stale_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.gap = handle, handle.getValueState("gap", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.gap.get()  # one call to the store; None if there is none
        first, last, ordinal, updates, observed, _, sequence = known or (None, None, None, -1, None, False, 0)
        for row in rows:
            at, number, value = row.at, row.ordinal, row.observed
            value = None if value is None or value != value else value
            first = at if first is None else min(first, at)
            if last is None or (at, number) >= (last, ordinal):
                last, ordinal, observed = at, number, value
            updates += 1
        newer = known is None or last > known[1]
        stale = False if newer else bool(known[5])
        if newer:
            if known is not None and not known[5]:
                self.handle.deleteTimer(self._due(known[1]))
            self.handle.registerTimer(self._due(last))
        self.gap.update((first, last, ordinal, updates, observed, stale, sequence + 1))
        yield CHANGED(key[0], "updated" if known else "created", first, last, updates, observed, stale, sequence + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, ordinal, updates, observed, _, sequence = self.gap.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= self._due(last):
            self.gap.update((first, last, ordinal, updates, observed, True, sequence + 1))
            yield CHANGED(key[0], "stale", first, last, updates, observed, True, sequence + 1)

    def _due(self, last: int) -> int:
        """Milliseconds."""
        return (last + self.stale_after) // 1000

    def close(self) -> None:
        """Nothing is held outside the state."""


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State with timers needs that store; queries that run already keep theirs."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def changes(findings: DataFrame, stale_seconds: int, delay: str) -> DataFrame:
    """Every change of every gap. findings: a stream of dedupe_key, run_at (timestamp), ordinal, observed."""
    rows = findings.select("dedupe_key", F.col("run_at"), F.unix_micros("run_at").alias("at"), F.col("ordinal").cast("long").alias("ordinal"), F.col("observed").cast("double").alias("observed"))
    keyed = rows.withWatermark("run_at", delay).groupBy("dedupe_key")
    return keyed.transformWithState(EvolvingGap(stale_seconds * 1_000_000), CHANGE, "Update", "EventTime")


def keep_up(stream: DataFrame, folder: str) -> None:
    """Appends the stream's changes to a table, a folder for each micro-batch, until the input has been read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    with rocks(stream.sparkSession):
        query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The gaps as the last change of each leaves them."""
    told = spark.read.schema(CHANGE).parquet(f"{folder}/changes")
    last = told.groupBy("dedupe_key").agg(F.max_by(F.struct("first_seen", "last_seen", "updates", "observed", "stale"), "sequence").alias("g"))
    moment = lambda c: F.timestamp_micros(F.col(f"g.{c}")).cast("timestamp_ntz").alias(c)
    return last.select("dedupe_key", moment("first_seen"), moment("last_seen"), "g.updates", "g.observed", "g.stale")
