"""A store over a log: the calls that a client makes, as functions that give DataFrames or values.

Writes are rows of a folder of log files; what is read is a query over it.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.operators import discovery, lease, segments, state
from tideline.sources import log as logs, snapshot
from tideline.sources.log import append
from tideline.sources.shared import exists, saved
from tideline.streaming.live import LOG

LEASES = "seq long, lease_id long, kind string, now_ms long, ttl_ms long, key string"


class Store:
    """One writer's view of a log kept under a path."""

    def __init__(self, spark: SparkSession, path: str, node: str = "node-0", clock=lambda: int(time.time() * 1000)):
        self.spark, self.path, self.node, self.clock = spark, path, node, clock
        self._make(f"{path}/log", LOG)
        self._make(f"{path}/leases", LEASES)
        last = self.log().agg(F.max("seq").alias("seq"), F.max(F.struct("phys_ms", "logical")).alias("t")).first()
        self.seq = last["seq"] or 0
        self.phys, self.logical = last["t"] or (0, -1)  # time never goes back behind the log's
        self.lease_seq, self.lease_id = self.spark.read.parquet(f"{path}/leases").agg(F.coalesce(F.max("seq"), F.lit(0)), F.coalesce(F.max("lease_id"), F.lit(0))).first()

    def _make(self, path: str, schema: str) -> None:
        if not exists(self.spark, path):
            self.spark.createDataFrame([], schema).write.parquet(path)

    def _stamp(self) -> tuple[int, int, int]:
        now = self.clock()
        self.logical = 0 if now > self.phys else self.logical + 1
        self.phys = max(now, self.phys)
        return now, self.phys, self.logical

    def _write(self, rows: list[tuple[str, str, str | None]]) -> int:
        out = []
        for op, key, value in rows:
            now, phys, logical = self._stamp()
            self.seq += 1
            out.append((self.seq, self.seq, phys, logical, self.node, op, key, value, now))
        self.spark.createDataFrame(out, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return self.seq

    def _delete_all(self, rows: DataFrame) -> int:
        """Deletes the keys of rows (lease_id, key) and detaches them, in one write each; how many."""
        rows = saved(rows.select("lease_id", "key"))
        n, keys = rows.agg(F.count(F.lit(1)), F.countDistinct("key")).first()
        if n:
            now, phys, logical = self._stamp()
            out = append(self.seq, rows.select("key").distinct().withColumn("at", F.xxhash64("key")), "at")
            out = out.select("seq", "revision", F.lit(phys).cast("long").alias("phys_ms"), (F.lit(logical) + F.col("seq") - self.seq - 1).cast("int").alias("logical"), F.lit(self.node).alias("node_id"), F.lit("DEL").alias("op"), "key", F.lit(None).cast("string").alias("value"), F.lit(now).cast("long").alias("now_ms"))
            out.write.mode("append").parquet(f"{self.path}/log")
            self.seq, self.logical = self.seq + keys, self.logical + keys - 1
            self._detach_all(rows, n)
        return n

    def _detach_all(self, rows: DataFrame, n: int) -> None:
        out = append(self.lease_seq, rows.withColumn("at", F.xxhash64("lease_id", "key")), "at")
        out = out.select("seq", "lease_id", F.lit("detach").alias("kind"), F.lit(self.clock()).cast("long").alias("now_ms"), F.lit(None).cast("long").alias("ttl_ms"), "key")
        out.write.mode("append").parquet(f"{self.path}/leases")
        self.lease_seq += n

    def _lease(self, lease_id: int, kind: str, ttl_ms: int | None = None, key: str | None = None) -> None:
        self.lease_seq += 1
        self.spark.createDataFrame([(self.lease_seq, lease_id, kind, self.clock(), ttl_ms, key)], LEASES).coalesce(1).write.mode("append").parquet(f"{self.path}/leases")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def _lease_log(self) -> DataFrame:
        return self.spark.read.schema(LEASES).parquet(f"{self.path}/leases")

    def leases(self) -> DataFrame:
        """lease_id, expiry and ttl as events left them; ended ones left out."""
        return lease.latest_leases(self._lease_log().where("key is null"))

    def lease_keys(self) -> DataFrame:
        events = self._lease_log().where("kind in ('attach', 'detach')")
        return lease.detached(events.withColumnRenamed("kind", "op"))

    def get(self, key: str) -> str | None:
        r = state.get(self.log(), key).first()
        return r["value"] if r else None

    def get_item(self, key: str) -> DataFrame:
        return state.get_item(self.log(), key)

    def by_prefix(self, prefix: str) -> DataFrame:
        return state.prefix_scan(self.log(), prefix)

    def export_all(self) -> DataFrame:
        return state.latest(self.log())

    def set(self, key: str, value: str) -> int:
        return self._write([("SET", key, value)])

    def delete(self, key: str) -> int:
        return self._write([("DEL", key, None)])

    def ensure(self, key: str, value: str, n: int = 1000) -> int:
        """Writes key/0 to key/n-1."""
        return self._write([("SET", f"{key}/{i}", value) for i in range(n)])

    def _compare(self, key: str, expected: int, op: str, value: str | None) -> int | None:
        now = self.get_item(key).first()
        if (now["revision"] if now else 0) != expected:
            return None
        return self._write([(op, key, value)])

    def compare_and_set(self, key: str, expected: int, value: str) -> int | None:
        """The new revision, or None if the key isn't at the expected one (0: never written)."""
        return self._compare(key, expected, "SET", value)

    def compare_and_delete(self, key: str, expected: int) -> int | None:
        return self._compare(key, expected, "DEL", None)

    def create_lease(self, ttl_ms: int) -> int:
        if ttl_ms <= 0:
            raise ValueError("ttl_ms must be positive")
        self.lease_id += 1
        self._lease(self.lease_id, "create", ttl_ms)
        return self.lease_id

    def _active(self, lease_id: int) -> bool:
        return lease.active_at(self.leases().where(F.col("lease_id") == lease_id), self.clock()).count() > 0

    def keep_alive(self, lease_id: int, ttl_ms: int | None = None) -> bool:
        ok = self._active(lease_id)
        self._lease(lease_id, "keepalive", ttl_ms)
        return ok

    def renew(self, lease_id: int, ttl_ms: int) -> bool:
        if ttl_ms <= 0:
            raise ValueError("ttl_ms must be positive")
        ok = self.leases().where(F.col("lease_id") == lease_id).count() > 0
        if ok:
            self._lease(lease_id, "renew", ttl_ms)
        return ok

    def revoke(self, lease_id: int) -> None:
        """Ends a lease and deletes its keys."""
        self._lease(lease_id, "revoke")
        self._delete_all(self.lease_keys().where(F.col("lease_id") == lease_id))

    def attach(self, lease_id: int, key: str) -> None:
        self._lease(lease_id, "attach", None, key)

    def detach(self, lease_id: int, key: str) -> None:
        self._lease(lease_id, "detach", None, key)

    def keys_of(self, lease_id: int) -> list[str]:
        """A lease's keys, which it then no longer has."""
        rows = saved(self.lease_keys().where(F.col("lease_id") == lease_id))
        keys = sorted(r["key"] for r in rows.collect())  # the caller asked for them
        if keys:
            self._detach_all(rows, len(keys))
        return keys

    def put_ephemeral(self, lease_id: int, key: str, value: str) -> bool:
        if not self._active(lease_id):
            return False
        self.set(key, value)
        self.attach(lease_id, key)
        return True

    def collect_expired(self) -> int:
        """Ends leases that have expired and deletes their keys; how many leases ended."""
        gone = saved(lease.expired_at(self.leases(), self.clock()).select("lease_id"))
        n = gone.count()
        if n:
            self._delete_all(self.lease_keys().join(gone, "lease_id"))
            out = append(self.lease_seq, gone, "lease_id")
            out.select("seq", "lease_id", F.lit("revoke").alias("kind"), F.lit(self.clock()).cast("long").alias("now_ms"), F.lit(None).cast("long").alias("ttl_ms"), F.lit(None).cast("string").alias("key")).write.mode("append").parquet(f"{self.path}/leases")
            self.lease_seq += n
        return n

    def load(self, at: str | None = None) -> DataFrame:
        """State from the whole log, or from a snapshot and the log after it."""
        found = snapshot.load(self.spark, at, self.log()) if at else None
        return self.export_all() if found is None else found

    def watch(self, prefix: str, from_seq: int = 0) -> DataFrame:
        """The history of keys under a prefix, as a batch; streaming.live has what follows it."""
        return logs.replay(self.log(), from_seq, prefix).orderBy("seq")

    def register(self, service: str, host: str, port: int, ttl_ms: int, instance: str | None = None, metadata: dict | None = None) -> tuple[str, int, int]:
        """Registers an instance under a lease; its key, revision and lease."""
        instance = instance if instance is not None else uuid.uuid4().hex
        if not service.strip() or not instance.strip():
            raise ValueError("a service and an instance need names")
        lease_id = self.create_lease(ttl_ms)
        row = self.spark.createDataFrame([(service, instance, host, port, metadata, lease_id)], "service string, instance string, host string, port int, metadata map<string, string>, lease_id long")
        r = discovery.registered(row, ttl_ms).first()
        self.put_ephemeral(lease_id, r["key"], r["value"])
        return r["key"], self.seq, lease_id

    def unregister(self, key: str, revision: int) -> bool:
        return self.compare_and_delete(key, revision) is not None

    def instances(self, service: str) -> DataFrame:
        return discovery.instances(self.log(), service)


class Scheduler:
    """What a store does on its own: collects leases, and writes snapshots once enough was written."""

    def __init__(self, store: Store, lease_every_ms: int = 12_000, snapshot_every_ms: int = 32_000, least_records: int = 10_000):
        self.store, self.every, self.least = store, {"lease": lease_every_ms, "snapshot": snapshot_every_ms}, least_records
        self.next = {k: store.clock() + n for k, n in self.every.items()}
        self.last_snapshot = 0

    def run_once(self) -> list[str]:
        """Does what is due; its names."""
        now, done = self.store.clock(), []
        for what, n in self.every.items():
            if now >= self.next[what]:
                self.next[what] = now + n
                if what == "lease":
                    self.store.collect_expired()
                    done.append(what)
                elif self.snapshot():
                    done.append(what)
        return done

    def start(self, every_s: float = 1.0) -> Callable[[], None]:
        """Does what is due again and again in the background, until the function that it gives is called."""
        stopped = threading.Event()

        def loop() -> None:
            while not stopped.wait(every_s):
                self.run_once()

        thread = threading.Thread(target=loop, daemon=True)
        thread.start()

        def stop() -> None:
            stopped.set()
            thread.join()

        return stop

    def snapshot(self, forced: bool = False) -> str | None:
        """Writes a snapshot if one is due, or anyway; its path."""
        due = segments.snapshot_due(self.store.log(), self.last_snapshot, self.least, forced).first()
        if not due["due"]:
            return None
        self.last_snapshot = due["last_seq"]
        return snapshot.write(f"{self.store.path}/snapshots", self.store.log(), due["last_seq"], self.store.node, self.store.leases(), self.store.lease_keys(), self.store.clock())
