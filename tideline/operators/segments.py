"""Segments of a log as a table of their bounds: rotation, pruning, collection, snapshots due."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes around a payload; the default size of a segment; the largest payload.
OVERHEAD = 20
SEGMENT_BYTES = 32 << 20
RECORD_BYTES = 100 << 20


def record_bytes(payload: Column) -> Column:
    return F.octet_length(payload) + OVERHEAD


SEGMENTED = "segment_id long, first_seq long, last_seq long, n long, bytes long"


#: Places of the log, a power of 2, whose sizes travel as one row.
STRETCH_BITS = 16
STRETCHES = "stretch long, seqs binary, sizes binary"


def _stretches(records: DataFrame) -> DataFrame:
    """The places and sizes of records, a row for each stretch of the log: numbers by their steps, deflated."""

    def run(key, table):
        seqs, sizes = table.column("seq").to_numpy(), table.column("bytes").to_numpy()
        order = np.argsort(seqs, kind="stable")
        steps = np.diff(seqs[order], prepend=0)
        return pa.table({"stretch": pa.array([key[0].as_py()], pa.int64()), "seqs": [zlib.compress(steps.tobytes(), 1)], "sizes": [zlib.compress(sizes[order].tobytes(), 1)]})

    rows = records.select(F.col("seq").cast("long").alias("seq"), F.col("bytes").cast("long").alias("bytes"), F.shiftright(F.col("seq").cast("long"), STRETCH_BITS).alias("stretch"))
    return rows.groupBy("stretch").applyInArrow(run, STRETCHES)


def rotated(records: DataFrame, cap: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of records (seq, bytes): a record that would go over the cap opens a new one, and one
    that is over it by itself has a segment alone.

    Each cut depends on the one before it.  Records are brought together by stretches in parallel; then
    one task goes from cut to cut through the stretches' sums, so its work grows with segments, and it reads a
    byte or two for each record, as a stream.
    """

    def fold(frames):
        at, first, last, n, size = 1, 0, 0, 0, 0
        for pdf in frames:
            out = []
            for a, b in zip(pdf["seqs"], pdf["sizes"], strict=True):
                seqs, sizes = np.cumsum(np.frombuffer(zlib.decompress(a), np.int64)), np.frombuffer(zlib.decompress(b), np.int64)
                sums, i = np.append(0, np.cumsum(sizes)), 0
                while i < len(seqs):
                    j = int(np.searchsorted(sums, sums[i] + cap - size, "right")) - 1
                    if j <= i and n:  # nothing more fits
                        out.append((at, first, last, n, size))
                        at, n, size = at + 1, 0, 0
                        continue
                    j = max(j, i + 1)
                    first = first if n else int(seqs[i])
                    last, n, size, i = int(seqs[j - 1]), n + j - i, size + int(sums[j] - sums[i]), j
            yield pd.DataFrame(out, columns=["segment_id", "first_seq", "last_seq", "n", "bytes"])
        if n:
            yield pd.DataFrame([(at, first, last, n, size)], columns=["segment_id", "first_seq", "last_seq", "n", "bytes"])

    return _stretches(records).coalesce(1).sortWithinPartitions("stretch").mapInPandas(fold, SEGMENTED)


def pruned(segments: DataFrame, after_seq: int) -> DataFrame:
    """The segments that a scan after a place has to read."""
    return segments.where(F.col("last_seq") > after_seq)


def collected(segments: DataFrame, least_seq: int) -> DataFrame:
    """What stays when records up to a place aren't needed: later ones, the active one, empty ones."""
    active = segments.agg(F.max("segment_id").alias("active"))
    return segments.crossJoin(F.broadcast(active)).where((F.col("last_seq") > least_seq) | (F.col("segment_id") == F.col("active")) | (F.col("n") == 0)).drop("active")


def manifest(segments: DataFrame, cap: int = SEGMENT_BYTES) -> str:
    """The log's JSON side file."""
    return manifest_row(segments, cap).first()["manifest"]


def manifest_row(segments: DataFrame, cap: int = SEGMENT_BYTES) -> DataFrame:
    """One row with the JSON of the side file."""
    last = lambda c: F.coalesce(F.max(c), F.lit(0).cast("long"))
    return segments.agg(F.to_json(F.struct(last("segment_id").alias("CurrentSegmentId"), last("last_seq").alias("LastSeq"), F.lit(cap).alias("SegmentSizeBytes"))).alias("manifest"))


def snapshot_due(log: DataFrame, last_snapshot_seq: int, every: int = 10_000, forced: bool = False) -> DataFrame:
    """One row: last_seq, and whether a snapshot is due."""
    last = F.coalesce(F.max("seq"), F.lit(0))
    due = (last >= 1) & (F.lit(forced) | (last - last_snapshot_seq >= every))
    return log.agg(last.alias("last_seq"), due.alias("due"))
