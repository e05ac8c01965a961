"""Cutting lineage, and filters by many ids that need no shuffle of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.sources.shared import released as released, saved as saved

#: Bits of an id filter, whatever the number of ids.
FILTER_BITS = 1 << 23


def tasks_for(df: DataFrame, each: int) -> int:
    """How many parts of about `each` bytes df's sources make, by their sizes on disk; as many as there
    are shuffle partitions, at least, or where the size isn't known."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parts, -(-size // each)) if size < 1 << 56 else parts


def _bit(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))


def marked(df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Adds __maybe: false only for rows whose id is surely not among ids.

    One hash per id in a bitmap of FILTER_BITS bits, made by a grouped bit_or: at most
    FILTER_BITS / 64 rows are broadcast.  A full bitmap lets all rows through.
    """
    bit = _bit(F.col(id_column))
    words = ids.select(F.shiftright(bit, 6).alias("__word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{id_column}`), {FILTER_BITS}) & 63 as int))").alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    own = df.withColumn("__w", F.shiftright(_bit(F.col(column)), 6))
    hit = F.expr(f"(__bits & shiftleft(1L, cast(pmod(xxhash64(`{column}`), {FILTER_BITS}) & 63 as int))) != 0")
    return own.join(F.broadcast(words), F.col("__w") == F.col("__word"), "left").withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("__w", "__word", "__bits")


def least_labels(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, label), the label the least node.

    Large star and small star in turn, until no row changes; each star takes the least
    neighbour with partial sums, so a node with very many links costs no task more.
    """
    edges = saved(links.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("u"), "m")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = down.join(low, F.col("a") == F.col("u"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        old, edges = edges, saved(small.where("a <> b").distinct())
        released(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = now
