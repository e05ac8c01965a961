"""The ordered change log as a DataFrame: where it comes from, how it is scanned and appended to.

change_log(seq, revision, phys_ms, logical, node_id, op, key, value, now_ms); op is SET or DEL, a
DEL has no value.  seq is the place in the log and starts from 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

COLUMNS = ["seq", "revision", "phys_ms", "logical", "node_id", "op", "key", "value"]


def change_log(spark: SparkSession, sf_dir: str, after: int = 0) -> DataFrame:
    """The log that the events table stands for; one node's clock is three days behind.

    after: records up to this place may be left out, by a filter that the reader of events knows.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    if after:
        e = e.where(F.col("event_id") >= after)
    now = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        (F.col("event_id") + 1).alias("seq"), (F.col("event_id") + 1).alias("revision"),
        (now - F.when(F.col("event_id") % 3 == 1, 259_200_000).otherwise(0)).alias("phys_ms"),
        (F.col("event_id") % 4).cast("int").alias("logical"), F.concat(F.lit("node-"), F.col("event_id") % 3).alias("node_id"),
        F.when(k % 5 == 0, "DEL").otherwise("SET").alias("op"),
        F.concat(F.lit("users/"), "user_id", F.lit("/"), "event_type").alias("key"),
        F.when(k % 5 != 0, F.col("props")).alias("value"), now.alias("now_ms"),
    )


def scan_after(log: DataFrame, seq: int, most: int | None = None) -> DataFrame:
    """Records after a place in the log, in order; the first `most` of them."""
    rows = log.where(F.col("seq") > seq).orderBy("seq")
    return rows if most is None else rows.limit(most)


def read_after(log: DataFrame, revision: int) -> DataFrame:
    """Records with a later revision, in the order of the log."""
    return log.where(F.col("revision") > revision).orderBy("seq")


def append(log_end: int, rows: DataFrame, arrival: str) -> DataFrame:
    """Rows with seq and revision after the log's end, in order of arrival, then of a hash of the row.

    One counter orders the whole log, so offsets are added up over ranges of arrival: rows are
    counted by range, and numbered within their own.  The ranges' bounds are values, so a task that runs
    again deals rows out as before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(arrival, [i / parts for i in range(1, parts)] or [0.5], 1000)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    ordered = rows.withColumn("__p", F.size(F.filter(bounds, lambda b: b <= F.col(arrival))))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.lit(log_end) + F.col("__from") + F.row_number().over(Window.partitionBy("__p").orderBy(arrival, F.xxhash64(*rows.columns)))
    return ordered.join(F.broadcast(starts.drop("__n")), "__p").withColumn("seq", place).withColumn("revision", F.col("seq")).drop("__p", "__from")


def gaps(log: DataFrame) -> DataFrame:
    """Places that are missing between the first and the last: after_seq, next_seq.  A segment whose
    tail was cut off shows up here."""
    step = F.shiftright("seq", 16)  # stretches, whose ends are then held against each other
    inner = F.lag("seq").over(Window.partitionBy(step).orderBy("seq"))
    ends = log.groupBy(step.alias("s")).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    across = ends.select(F.lag("hi").over(Window.orderBy("s")).alias("after_seq"), F.col("lo").alias("next_seq"))  # a row for each stretch
    rows = log.select(inner.alias("after_seq"), F.col("seq").alias("next_seq")).unionByName(across)
    return rows.where("next_seq > after_seq + 1")


def each(log: DataFrame, handler: Callable[[Iterator[Row]], None], after: int = 0) -> None:
    """Calls handler on every partition's records after a place, in order within the partition."""
    scan_after(log, after).foreachPartition(handler)


def by_prefix(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows with each row of prefixes (prefix, ...) that their key begins with.

    Keys are cut at each length that a prefix has, and joined with the prefixes by
    equality, so that many prefixes cost no more than a few.
    """
    lengths = prefixes.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # at most as many as a key has characters
    cut = rows.crossJoin(F.broadcast(lengths)).withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("key"))))
    cut = cut.withColumn("prefix", F.expr("substring(key, 1, n)")).drop("lengths", "n")
    return cut.join(prefixes, "prefix")


def under(key: Column, prefix: str | bytes) -> Column:
    """Keys under a prefix; bytes as a range as well, which readers can push down."""
    if isinstance(prefix, str):
        return F.startswith(key, F.lit(prefix))
    rest = prefix.rstrip(b"\xff")
    out = key >= F.lit(bytearray(prefix))
    return out & (key < F.lit(bytearray(rest[:-1] + bytes([rest[-1] + 1])))) if rest else out


def replay(log: DataFrame, from_seq: int, prefix: str) -> DataFrame:
    """History of keys under a prefix as events, sets and deletes, with no regard to stale ones."""
    rows = log.where((F.col("seq") > from_seq) & under(F.col("key"), prefix))
    return rows.select(F.when(F.col("op") == "SET", "Set").otherwise("Delete").alias("kind"), "key", "value", "phys_ms", "logical", "node_id", "revision", "seq")
