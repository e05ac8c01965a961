"""Leases from their events, and the keys that live as long as a lease does.

lease_events(seq, lease_id, kind, now_ms, ttl_ms): kind is acquire, create, keepalive, renew,
release, revoke or put (a key written under the lease).  A lease is active while its expiry is later than now.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.operators.state import latest


def lease_events(log: DataFrame, ttl_ms: int) -> DataFrame:
    """Each user's events keep a lease of that user alive."""
    lease = F.split("key", "/")[1].cast("long")
    return log.select("seq", lease.alias("lease_id"), F.lit("keepalive").alias("kind"), "now_ms", F.lit(ttl_ms).cast("long").alias("ttl_ms"))


FOLDED = "lease_id long, seq long, kind string, now_ms long, ok boolean, expire_at_ms long, left_ttl_ms long"


def folded(events: DataFrame) -> DataFrame:
    """Every event with its outcome, and the expiry and ttl it leaves behind (null: no lease).

    acquire and create open or replace; keepalive fails, and ends the lease, once it has
    expired, and changes nothing with a ttl that isn't positive; a null ttl keeps the lease's own;
    renew asks only that the lease exists; release and revoke end it; put asks that it is active.

    A lease's events depend on one another; they stream in order, with one lease's state in memory.
    """

    def fold(frames):
        lease, expire, ttl = None, None, None
        for pdf in frames:
            out = []
            for i, kind, now, new in zip(pdf["lease_id"], pdf["kind"], pdf["now_ms"], pdf["ttl_ms"], strict=True):
                if i != lease:
                    lease, expire, ttl = i, None, None
                given = None if pd.isna(new) else int(new)
                ok = True
                if kind in ("acquire", "create"):
                    if given is None or given <= 0:
                        ok = False
                    else:
                        expire, ttl = now + given, given
                elif kind == "keepalive":
                    if expire is None or expire <= now:
                        ok, expire = False, None
                    elif (given if given is not None else ttl) > 0:
                        ttl = given if given is not None else ttl
                        expire = now + ttl
                elif kind == "renew":
                    if expire is None or given is None or given <= 0:
                        ok = False
                    else:
                        expire, ttl = now + given, given
                elif kind == "put":
                    ok = expire is not None and expire > now
                else:
                    ok, expire = expire is not None, None
                out.append((ok, expire, ttl if expire is not None else None))
            yield pdf.assign(ok=[x[0] for x in out], expire_at_ms=pd.array([x[1] for x in out], dtype="Int64"), left_ttl_ms=pd.array([x[2] for x in out], dtype="Int64"))[["lease_id", "seq", "kind", "now_ms", "ok", "expire_at_ms", "left_ttl_ms"]]

    rows = events.select("lease_id", "seq", "kind", "now_ms", "ttl_ms").repartition("lease_id").sortWithinPartitions("lease_id", "seq")
    return rows.mapInPandas(fold, FOLDED)


def sessions(events: DataFrame) -> DataFrame:
    """Unbroken lives of leases that are kept alive: a new one begins once an event comes at or after
    the expiry that the event before it set."""
    order = Window.partitionBy("lease_id").orderBy("seq")
    gone = F.lag(F.col("now_ms") + F.col("ttl_ms")).over(order)
    rows = events.withColumn("__new", F.when(gone.isNull() | (F.col("now_ms") >= gone), 1).otherwise(0))
    rows = rows.withColumn("session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("lease_id", "session").agg(F.min("now_ms").alias("start_ms"), F.max_by(F.col("now_ms") + F.col("ttl_ms"), "seq").alias("end_ms"), F.count(F.lit(1)).alias("n_events"))


def keepalives(events: DataFrame) -> DataFrame:
    """Whether each keepalive found its lease alive (the first opens it)."""
    order = Window.partitionBy("lease_id").orderBy("seq")
    gone = F.lag(F.col("now_ms") + F.col("ttl_ms")).over(order)
    return events.select("seq", "lease_id", (gone.isNotNull() & (F.col("now_ms") < gone)).alias("alive"), (F.col("now_ms") + F.col("ttl_ms")).alias("expire_at_ms"))


def latest_leases(events: DataFrame) -> DataFrame:
    """Each lease as its events leave it: lease_id, expire_at_ms, ttl_ms; ended ones left out."""
    last = folded(events).groupBy("lease_id").agg(F.max_by(F.struct("expire_at_ms", F.col("left_ttl_ms").alias("ttl_ms")), "seq").alias("e"))
    return last.where("e.expire_at_ms is not null").select("lease_id", "e.*")


def active_at(leases: DataFrame, now_ms: int | Column) -> DataFrame:
    return leases.where(F.col("expire_at_ms") > now_ms)


def expired_at(leases: DataFrame, now_ms: int | Column) -> DataFrame:
    """What a collection at this time takes; a lease renewed since is not due."""
    return leases.where(F.col("expire_at_ms") <= now_ms)


def attached(attachments: DataFrame) -> DataFrame:
    """lease_keys as a set."""
    return attachments.select("lease_id", "key").dropDuplicates()


def detached(events: DataFrame) -> DataFrame:
    """Keys whose last event (seq, lease_id, key, op attach or detach) attached them."""
    return events.groupBy("lease_id", "key").agg(F.max_by("op", "seq").alias("op")).where("op = 'attach'").select("lease_id", "key")


def take(lease_keys: DataFrame, lease_id: int) -> tuple[DataFrame, DataFrame]:
    """A lease's keys, and the index without them."""
    return lease_keys.where(F.col("lease_id") == lease_id), lease_keys.where(F.col("lease_id") != lease_id)


def indexed(lease_keys: DataFrame) -> DataFrame:
    """A row for each lease with its keys in order."""
    return attached(lease_keys).groupBy("lease_id").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def restored_index(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("lease_id", F.explode("keys").alias("key"))


def exported(leases: DataFrame, lease_keys: DataFrame, now_ms: int | Column) -> DataFrame:
    """Active leases that hold at least one key, with the keys."""
    return active_at(leases, now_ms).join(indexed(lease_keys), "lease_id")


def restored(snapshot: DataFrame, now_ms: int | Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leases that are still active, their keys, and the next free id."""
    alive = active_at(snapshot, now_ms)
    return alive.drop("keys"), restored_index(alive), snapshot.agg((F.coalesce(F.max("lease_id"), F.lit(0)) + 1).alias("next_id"))


def put_ephemeral(puts: DataFrame, events: DataFrame) -> DataFrame:
    """Puts (seq, lease_id, key, value, now_ms) whose lease is active when they come, by its events up
    to then; seq orders puts and events.  They are to be appended to the log, and attached."""
    asked = puts.select("seq", "lease_id", F.lit("put").alias("kind"), "now_ms", F.lit(None).cast("long").alias("ttl_ms"))
    ok = folded(events.select(*asked.columns).unionByName(asked)).where("kind = 'put' and ok").select("lease_id", "seq")
    return puts.join(ok, ["lease_id", "seq"])


def cascade(log: DataFrame, leases: DataFrame, lease_keys: DataFrame, now_ms: int | Column, node: str = "lease") -> DataFrame:
    """State after the keys of expired leases have been deleted, by records newer than the log's."""
    gone = expired_at(leases, now_ms).join(attached(lease_keys), "lease_id").select("key").distinct()
    deletes = gone.select(F.lit(1 << 62).alias("seq"), F.lit(1 << 62).alias("revision"), F.lit(now_ms).cast("long").alias("phys_ms"), F.lit(1 << 30).alias("logical"), F.lit(node).alias("node_id"), F.lit("DEL").alias("op"), "key", F.lit(None).cast("string").alias("value"))
    return latest(log.select(*deletes.columns).unionByName(deletes))
