"""Live watches, state and leases with Structured Streaming.

One ordered source serves replay and what follows, so nothing falls between them.  The stateful
operators need spark.sql.streaming.stateStore.providerClass set to the RocksDB provider (see
configure).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tideline.sources.log import replay, under

LOG = "seq long, revision long, phys_ms long, logical int, node_id string, op string, key string, value string, now_ms long"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of log files as a stream."""
    reader = spark.readStream.schema(LOG)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def watch(log: DataFrame, prefix: str, told: Callable[[DataFrame, int], None], checkpoint: str, from_seq: int = 0, **trigger) -> StreamingQuery:
    """Calls told(events, batch) for events under a prefix after a seq, history first; the query's
    stop() ends the watch."""
    if not prefix:
        raise ValueError("a watch needs a prefix")
    if told is None:
        raise ValueError("a watch needs a callback")
    return replay(log, from_seq, prefix).writeStream.foreachBatch(told).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Watches:
    """Watches that come and go while one stream runs: give publish to foreachBatch.

    A watch has a callback, which gets each batch's events in order, or a buffer; a full buffer
    drops its oldest.
    """

    def __init__(self):
        self.next_id, self.held = 0, {}

    def subscribe(self, prefix: str, told: Callable[[DataFrame], None] | None = None, capacity: int = 16) -> int:
        if not prefix:
            raise ValueError("a watch needs a prefix")
        self.next_id += 1
        self.held[self.next_id] = (prefix, told, deque(maxlen=capacity))
        return self.next_id

    def unsubscribe(self, watch_id: int) -> bool:
        return self.held.pop(watch_id, None) is not None

    def publish(self, events: DataFrame, batch: int = 0) -> None:
        for prefix, told, buffer in list(self.held.values()):
            mine = events.where(under(F.col("key"), prefix))
            if told:
                told(mine.orderBy("seq"))
            else:
                buffer += reversed(mine.orderBy(F.desc("seq")).limit(buffer.maxlen).collect())

    def take(self, watch_id: int) -> list:
        """What a watch's buffer holds, which it then no longer does."""
        buffer = self.held[watch_id][2]
        out = list(buffer)
        buffer.clear()
        return out


CHANGED = "key string, value string, phys_ms long, logical int, node_id string, revision long, seq long"


class LastWriter(StatefulProcessor):
    """Holds each key's winning timestamp; puts out only records that are later than it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.won = handle.getValueState("won", "phys_ms long, logical int, node_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        won = tuple(self.won.get()) if self.won.exists() else None
        best, out = won, []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                out.append(r)
        kept = []
        for r in sorted(out, key=lambda r: r.seq):
            at = (int(r.phys_ms), int(r.logical), r.node_id)
            if best is None or at > best:
                best = at
                kept.append((r.key, None if pd.isna(r.value) else r.value, at[0], at[1], at[2], int(r.revision), int(r.seq)))
        if best != won:
            self.won.update(best)
        yield pd.DataFrame(kept, columns=["key", "value", "phys_ms", "logical", "node_id", "revision", "seq"])

    def close(self) -> None:
        pass


def changed(log: DataFrame) -> DataFrame:
    """The stream of records that change state; the last of a key is its state."""
    return log.select("key", "value", "phys_ms", "logical", "node_id", "revision", "seq").groupBy("key").transformWithStateInPandas(LastWriter(), CHANGED, "Append", "none")


EXPIRED = "lease_id long, expire_at_ms long"


class LeaseTimers(StatefulProcessor):
    """Holds each lease's expiry with a timer on it; puts out leases that expire."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "expire_at_ms long, ttl_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        expire, ttl = tuple(self.lease.get()) if self.lease.exists() else (None, None)
        before = expire
        events = [r for pdf in rows for r in pdf.itertuples(index=False)]
        for r in sorted(events, key=lambda r: r.seq):
            now, new = int(r.now_ms), None if pd.isna(r.ttl_ms) else int(r.ttl_ms)
            if r.kind in ("acquire", "create") and new and new > 0:
                expire, ttl = now + new, new
            elif r.kind == "keepalive" and expire is not None:
                if expire <= now:
                    expire = None
                elif (new if new is not None else ttl) > 0:
                    ttl = new if new is not None else ttl
                    expire = now + ttl
            elif r.kind == "renew" and expire is not None and new and new > 0:
                expire, ttl = now + new, new
            elif r.kind in ("release", "revoke"):
                expire = None
        if before is not None and before != expire:
            self.handle.deleteTimer(before)
        if expire is None:
            self.lease.clear()
        else:
            self.lease.update((expire, ttl))
            if before != expire:
                self.handle.registerTimer(expire)
        yield pd.DataFrame({"lease_id": [], "expire_at_ms": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.lease.exists() and self.lease.get()[0] <= at:
            self.lease.clear()
            yield pd.DataFrame({"lease_id": [int(key[0])], "expire_at_ms": [at]})
        else:
            yield pd.DataFrame({"lease_id": [], "expire_at_ms": []})

    def close(self) -> None:
        pass


def expiries(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The stream of leases that expire, in event time; events have the columns of lease_events."""
    rows = events.withColumn("at", F.timestamp_millis("now_ms")).withWatermark("at", late)
    return rows.groupBy("lease_id").transformWithStateInPandas(LeaseTimers(), EXPIRED, "Append", "EventTime")
