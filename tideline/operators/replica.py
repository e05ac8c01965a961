"""Replicas: merging logs, what a follower is sent, and in what pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.operators.state import latest
from tideline.sources.log import COLUMNS

#: Fixed value: bytes of a snapshot's chunk.
CHUNK_BYTES = 64 << 10


def merged(*logs: DataFrame) -> DataFrame:
    """State from several replicas' logs; records that came by several ways count once."""
    rows = logs[0].select(*COLUMNS)
    for other in logs[1:]:
        rows = rows.unionByName(other.select(*COLUMNS))
    return latest(rows)


def caught_up(follower: DataFrame, leader: DataFrame) -> DataFrame:
    """What a follower lacks: nothing, a log suffix, or a snapshot first (see plan)."""
    at = follower.agg(F.coalesce(F.max("revision"), F.lit(0)).alias("at")).scalar()
    return leader.where(F.col("revision") > at)


def plan(follower: DataFrame, leader: DataFrame) -> DataFrame:
    """One row: from_revision, last_revision, require_snapshot (the follower is behind)."""
    a = follower.agg(F.coalesce(F.max("revision"), F.lit(0)).alias("from_revision"))
    b = leader.agg(F.coalesce(F.max("revision"), F.lit(0)).alias("last_revision"))
    return a.crossJoin(b).withColumn("require_snapshot", F.col("from_revision") < F.col("last_revision"))


def wal_batches(log: DataFrame, after: int, size: int) -> DataFrame:
    """Batches of revisions: batch, base_revision, last_revision, n, and the records in order."""
    rows = log.where(F.col("revision") > after).withColumn("batch", F.floor((F.col("revision") - after - 1) / size).cast("long"))
    record = F.struct(F.col("seq"), *[F.col(c) for c in COLUMNS[1:]])
    return rows.groupBy("batch").agg((F.min("revision") - 1).alias("base_revision"), F.max("revision").alias("last_revision"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(record)).alias("records"))


def snapshot_chunks(total_bytes: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """chunk_index, offset and length of the pieces of a snapshot of total_bytes (one row)."""
    n = F.ceil(F.col("total_bytes") / chunk).cast("int")
    rows = total_bytes.where("total_bytes > 0").select("total_bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return rows.select("chunk_index", (F.col("chunk_index").cast("long") * chunk).alias("offset"), F.least(F.lit(chunk), F.col("total_bytes") - F.col("chunk_index").cast("long") * chunk).cast("long").alias("length"))


def with_snapshot(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """State of a snapshot (rows of a state, with their seq) and the log after it."""
    rows = snapshot.select("seq", "revision", "phys_ms", "logical", "node_id", F.when(F.col("value").isNull(), "DEL").otherwise("SET").alias("op"), "key", "value")
    return merged(rows, log)
