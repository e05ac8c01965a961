"""Gapless numbers within groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def numbered(df: DataFrame, group: str, spread: list[Column], name: str, bucket: Column | None = None) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... within each value of `group` (never null).

    Rows of a group are dealt over as many buckets as there are shuffle
    partitions, by a hash of `spread`; each bucket is numbered by itself and
    starts after the buckets before it.  The table of starts has one row for
    each group and bucket.  Order within a group is by bucket, then `spread`, then a hash of the row, so a
    task that runs again numbers as before.
    `bucket`: what to take for the hash, where rows have an order of their own.
    """
    spark = df.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])
    rows = df.withColumns({**{f"__k{i}": c for i, c in enumerate(spread)}, "__whole": whole})
    keys = [f"__k{i}" for i in range(len(spread))]
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if bucket is None else bucket)
    counts = rows.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("__g"), F.col("__b").alias("__gb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    own = Window.partitionBy(group, "__b").orderBy(*keys, "__whole")
    rows = rows.join(starts, (F.col(group) == F.col("__g")) & (F.col("__b") == F.col("__gb")))
    return rows.withColumn(name, (F.col("__from") + F.row_number().over(own) - 1).cast("long")).drop("__b", "__g", "__gb", "__from", "__whole", *keys)
