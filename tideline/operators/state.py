"""State from a log: the last writer wins; prefix and point queries; compare and set."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.sources.log import by_prefix, under

#: Prefixes that are tried one by one on each record.
MOST_FILTERS = 64

STAMP = ("phys_ms", "logical", "node_id")


def stamp() -> Column:
    """The hybrid timestamp, ordered by its fields."""
    return F.struct(*STAMP)


def latest(log: DataFrame) -> DataFrame:
    """One row for each key, tombstones (null values) included: the greatest timestamp, and of
    equal ones the first in the log.  Partial maxima are taken before the shuffle."""
    rank = F.struct(*STAMP, (-F.col("seq")).alias("back"))
    row = F.struct("value", "phys_ms", "logical", "node_id", "revision", "seq")
    return log.groupBy("key").agg(F.max_by(row, rank).alias("s")).select("key", "s.*")


def live(state: DataFrame) -> DataFrame:
    return state.where("value is not null")


def get(log: DataFrame, key: str) -> DataFrame:
    """The value of a key, if it is live."""
    return get_item(log, key).where("value is not null").select("value")


def get_item(log: DataFrame, key: str) -> DataFrame:
    """The whole row of a key, tombstone or not."""
    return latest(log.where(F.col("key") == key))


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    """Live keys under a prefix, in byte order.  The prefix goes below the aggregation, the test for
    tombstones stays above it."""
    return live(latest(log.where(under(F.col("key"), prefix)))).orderBy("key")


def get_live_item(log: DataFrame, key: str) -> DataFrame:
    """The whole row of a key, if it is live."""
    return live(get_item(log, key))


def prefix_counts(log: DataFrame, prefixes: list[str]) -> DataFrame:
    """For each prefix the number of live keys under it.  Few prefixes go below the aggregation."""
    wanted = log.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(prefixes)], "prefix string")
    if len(prefixes) <= MOST_FILTERS:
        log = log.where(reduce(or_, (under(F.col("key"), p) for p in prefixes), F.lit(False)))
    found = by_prefix(live(latest(log)), wanted).groupBy("prefix").agg(F.count("key").alias("n"))
    return wanted.join(found, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"))


def write_sorted(state: DataFrame, path: str, files: int | None = None) -> None:
    """Writes a state so that a prefix lies in few files: ranges of keys, sorted, with their bounds."""
    rows = state.repartitionByRange(files, "key") if files else state.repartitionByRange("key")
    rows.sortWithinPartitions("key").write.parquet(path)


def changes(log: DataFrame) -> DataFrame:
    """The records that changed state when they came: those later than all before them."""
    before = F.max(stamp()).over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("__before", before).where(F.col("__before").isNull() | (stamp() > F.col("__before"))).drop("__before")


def arrival_visible(log: DataFrame, prefix: str) -> DataFrame:
    """Compat: what a prefix scan sees where the index follows arrival, so that a stale delete hides
    a live key and a stale set shows none."""
    rank = F.struct(*STAMP, (-F.col("seq")).alias("back"))
    row = F.struct("value", "phys_ms", "logical", "node_id", "revision", "seq")
    rows = log.where(under(F.col("key"), prefix)).groupBy("key").agg(F.max_by(row, rank).alias("s"), F.max_by("op", "seq").alias("last_op"))
    return rows.where("s.value is not null and last_op = 'SET'").select("key", "s.*")


CAS = "req_seq long, key string, expected long, op string, accepted boolean, revision long"


def compare_and_set(requests: DataFrame) -> DataFrame:
    """Requests (req_seq, key, expected, op) by key in order: accepted iff the expected revision is
    the key's, or 0 for a key that was never written.  A tombstone keeps its revision.
    An accepted request's revision is its req_seq.

    A key's requests depend on one another; they are folded in batches that stream in order, so a key
    with very many of them holds one revision only.
    """

    def fold(frames):
        key, current = None, 0
        for pdf in frames:
            accepted = []
            for k, expected, seq in zip(pdf["key"], pdf["expected"], pdf["req_seq"], strict=True):
                if k != key:
                    key, current = k, 0
                accepted.append(expected == current)
                if accepted[-1]:
                    current = seq
            ok = pd.Series(accepted, index=pdf.index, dtype=bool)
            yield pdf.assign(accepted=ok, revision=pdf["req_seq"].where(ok).astype("Int64"))[["req_seq", "key", "expected", "op", "accepted", "revision"]]

    rows = requests.select("req_seq", "key", "expected", "op").repartition("key").sortWithinPartitions("key", "req_seq")
    return rows.mapInPandas(fold, CAS)


def cas_log(requests: DataFrame) -> DataFrame:
    """The accepted requests with their values and stamps, as records of a log, and whether each changed
    the state when it came (an older stamp than the key's doesn't)."""
    ok = compare_and_set(requests).where("accepted").select(F.col("req_seq").alias("__r"))
    rows = requests.join(ok, F.col("req_seq") == F.col("__r")).drop("__r")
    before = F.max(stamp()).over(Window.partitionBy("key").orderBy("req_seq").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("changed", F.coalesce(stamp() > before, F.lit(True)))


def without(keys: DataFrame, removed: DataFrame) -> DataFrame:
    """Keys but for removed ones."""
    return keys.join(removed.select("key").distinct(), "key", "left_anti")
