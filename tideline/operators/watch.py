"""Watches over a log in batch: which watch gets which event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideline.operators.state import changes
from tideline.sources.log import by_prefix, replay


def watch_changes(log: DataFrame, prefix: str) -> DataFrame:
    """What a watch on a prefix is told while the log is written: records that changed state."""
    return replay(changes(log), 0, prefix)


def fan_out(events: DataFrame, watches: DataFrame) -> DataFrame:
    """Events with each watch (watch_id, prefix) that they belong to; an empty prefix is no watch."""
    return by_prefix(events, watches.where("prefix <> ''"))


def lines(events: DataFrame) -> DataFrame:
    """Events as server-sent text: seq, line."""
    body = F.to_json(F.struct("kind", "key", "value", "revision"))
    return events.select("seq", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("line"))


def newest(events: DataFrame, watch: str, capacity: int) -> DataFrame:
    """What a full buffer that drops its oldest still holds for each watch."""
    rank = F.row_number().over(Window.partitionBy(watch).orderBy(F.desc("seq")))
    return events.withColumn("__n", rank).where(F.col("__n") <= capacity).drop("__n")
