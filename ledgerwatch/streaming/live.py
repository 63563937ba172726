"""A bounded view of live entries per severity, kept in the state of a stream.

Each severity holds its newest entries, at most so many and none older than a time to live,
as a list in the state store; nothing is read again from a sink. Time is that of the entries:
the watermark runs a time to live behind the newest one, so what it has passed is dead, and
what comes later than it would be dead on arrival. A timer at the oldest entry of a severity
wakes it when the watermark passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerwatch.operators.stats import BUFFER_SIZE, BUFFER_TTL_SECONDS
from ledgerwatch.session import require_columns, state_partitions
from ledgerwatch.sources.commits import write_batch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ENTRY = "key string, at long, payload string"
_CHANGE = "severity string, key string, inserted_at timestamp, payload string, live boolean"


class NewestEntries(StatefulProcessor):
    """The newest ``max_size`` entries of one severity; emits what enters and what leaves.

    Equal keys count once, with their newest time. Of equal times the smaller key is newer.
    """

    def __init__(self, max_size: int) -> None:
        self.max_size = max_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", _ENTRY)

    def _changed(self, severity: str, fresh: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        """Take up new entries, drop the dead and the oldest beyond the bound."""
        before = {key: (at, payload) for key, at, payload in self.entries.get()}
        after = dict(before)
        for key, at, payload in fresh:
            if key not in after or after[key][0] < at:
                after[key] = (at, payload)
        newest = sorted(((-at, key, payload) for key, (at, payload) in after.items() if at >= 1000 * watermark))[: self.max_size]
        after = {key: (-at, payload) for at, key, payload in newest}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if after:
            self.entries.put([(key, at, payload) for key, (at, payload) in after.items()])
            self.handle.registerTimer(min(at for at, _ in after.values()) // 1000 + 1)
        else:
            self.entries.clear()
        rows = [(severity, k, *before[k], False) for k in before if k not in after]
        rows += [(severity, k, *v, True) for k, v in after.items() if before.get(k) != v]
        if rows:
            out = pd.DataFrame(rows, columns=["severity", "key", "inserted_at", "payload", "live"])
            yield out.assign(inserted_at=pd.to_datetime(out["inserted_at"], unit="us"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [r for part in rows for r in zip(part["key"], part["at"].tolist(), part["payload"])]
        yield from self._changed(key[0], fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._changed(key[0], [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def live_changes(
    entries: DataFrame, max_size: int = BUFFER_SIZE, ttl_seconds: int = BUFFER_TTL_SECONDS,
    key: str = "tx_hash", inserted_at: str = "detected_at",
) -> DataFrame:
    """What enters and leaves the live view of each severity: ``severity, key, inserted_at,
    payload, live``; the payload holds the other columns as JSON.

    A severity's state is at most ``max_size`` entries. Null severities are a group of their
    own; entries without a key or a time are left out. The stream needs the RocksDB state
    store (see ``rocksdb_state``) and output mode ``update``.
    """
    require_columns(entries, "severity", key, inserted_at)
    if max_size < 1 or ttl_seconds < 1:
        raise ValueError("size and time to live must be positive")
    rest = [F.col(c) for c in entries.columns if c not in ("severity", key, inserted_at)]
    payload = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    rows = entries.where(F.col(key).isNotNull() & F.col(inserted_at).isNotNull()).select(
        "severity", F.col(key).cast("string").alias("key"), F.col(inserted_at).cast("timestamp").alias("inserted_at"),
        F.unix_micros(F.col(inserted_at).cast("timestamp")).alias("at"), payload.alias("payload"))
    timed = rows.withWatermark("inserted_at", f"{int(ttl_seconds)} seconds")
    return timed.groupBy("severity").transformWithStateInPandas(
        statefulProcessor=NewestEntries(max_size), outputStructType=_CHANGE, outputMode="Update", timeMode="EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """A stream that starts inside this block keeps its state in RocksDB, as lists in state need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def keep_live(
    entries: DataFrame, path: str, checkpoint: str, max_size: int = BUFFER_SIZE, ttl_seconds: int = BUFFER_TTL_SECONDS,
    key: str = "tx_hash", inserted_at: str = "detected_at", available_now: bool = True, every: str = "5 seconds",
    also: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Keep the live view of a stream of entries, and store its changes in a table with a log.

    ``also`` gets the changes of every micro-batch too, to pass them on.
    """
    def sink(changes: DataFrame, batch_id: int) -> None:
        write_batch(changes, path, batch_id)
        if also is not None:
            also(changes, batch_id)

    changes = live_changes(entries, max_size, ttl_seconds, key, inserted_at)
    writer = changes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    with state_partitions(entries.sparkSession), rocksdb_state(entries.sparkSession):
        return writer.trigger(**trigger).start()


def live_view(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The live entries as the state store of a stream holds them: ``severity, key, inserted_at,
    payload``, after its last committed batch. Works while the stream runs and after it ended."""
    stored = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "entries").load()
    entry = F.col("list_element")
    return stored.select(
        F.col("key.severity").alias("severity"), entry["key"].alias("key"),
        F.timestamp_micros(entry["at"]).alias("inserted_at"), entry["payload"].alias("payload"))


def view_of_changes(changes: DataFrame) -> DataFrame:
    """The live entries from stored changes with their ``batch_id``: the last word on each key."""
    last = changes.groupBy("severity", "key").agg(F.max(F.struct("batch_id", "live", "inserted_at", "payload")).alias("l"))
    return last.where("l.live").select("severity", "key", "l.inserted_at", "l.payload")
