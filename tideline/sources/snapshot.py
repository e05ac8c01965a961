"""Snapshots: state and active leases at a place in the log, and how to go on from there.

A snapshot is a folder with kv and leases as Parquet and one row of meta, which is
written last: a folder without it is no snapshot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from tideline.operators import lease, replica
from tideline.operators.state import latest
from tideline.sources import wal


def write(path: str, log: DataFrame, last_seq: int, node: str = "local", leases: DataFrame | None = None, lease_keys: DataFrame | None = None, now_ms: int = 0, segments_path: str | None = None) -> str:
    """Writes the state up to last_seq, tombstones included, with leases that hold keys; its path.

    segments_path: binary segments that end by last_seq are deleted afterwards."""
    spark, at = log.sparkSession, f"{path}/{last_seq:020d}-{uuid.uuid4().hex[:8]}"
    latest(log.where(F.col("seq") <= last_seq)).write.parquet(f"{at}/kv")
    if leases is not None:
        lease.exported(leases, lease_keys, now_ms).write.parquet(f"{at}/leases")
    meta = spark.range(1).select(F.lit(last_seq).cast("long").alias("last_seq"), F.lit(node).alias("node"), F.lit(leases is not None).alias("has_leases"))
    meta.coalesce(1).write.parquet(f"{at}/meta")
    if segments_path is not None:
        wal.collect_segments(segments_path, last_seq)
    return at


def load(spark: SparkSession, at: str, log: DataFrame) -> DataFrame | None:
    """State from a snapshot and the log after it; None if there is no whole snapshot."""
    try:
        meta = spark.read.parquet(f"{at}/meta").first()
        kv = spark.read.parquet(f"{at}/kv")
    except AnalysisException:
        return None
    if meta is None or meta["last_seq"] is None:
        return None
    return replica.with_snapshot(kv, log.where(F.col("seq") > meta["last_seq"]))


def load_leases(spark: SparkSession, at: str, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The snapshot's leases that are still active, their keys, and the next free id."""
    try:
        return lease.restored(spark.read.parquet(f"{at}/leases"), now_ms)
    except AnalysisException:
        return None
