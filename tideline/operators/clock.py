"""Hybrid logical clocks in closed form: windows in place of a fold.

`clock` names the column that tells clocks apart, `order` a whole number that orders events.  A
clock's events are looked at in stretches of the order, so few clocks are no few tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Places of the order, a power of 2, that one task looks at.
STRETCH_BITS = 16


def _greatest(rows: DataFrame, value: Column, clock: str, order: str) -> DataFrame:
    """Adds hlc_phys, the greatest value of a clock so far.

    Each stretch of the order takes its own maxima and those of the stretches before it, which
    are a row for each clock and stretch.
    """
    rows = rows.withColumns({"__v": value, "__s": F.shiftright(F.col(order).cast("long"), STRETCH_BITS)})
    ends = rows.groupBy(clock, "__s").agg(F.max("__v").alias("__m"))
    before = F.max("__m").over(Window.partitionBy(clock).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col(clock).alias("__c"), F.col("__s").alias("__cs"), before.alias("__before"))
    rows = rows.join(ends, F.col(clock).eqNullSafe(F.col("__c")) & (F.col("__s") == F.col("__cs")))
    upto = Window.partitionBy(clock, "__s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("hlc_phys", F.greatest(F.max("__v").over(upto), "__before")).drop("__v", "__s", "__c", "__cs", "__before")


def next_local(rows: DataFrame, now: str, clock: str, order: str) -> DataFrame:
    """hlc_phys: the greatest time so far; hlc_logical: events since it was reached."""
    rows = _greatest(rows, F.col(now), clock, order)
    run = Window.partitionBy(clock, "hlc_phys").orderBy(order)
    return rows.withColumn("hlc_logical", (F.row_number().over(run) - 1).cast("int"))


def on_receive(rows: DataFrame, now: str, remote_phys: str, remote_logical: str, clock: str, order: str) -> DataFrame:
    """As next_local, for events that may bring a remote timestamp (null: a local one).

    Within a run of one hlc_phys, with i counting from 0, a remote tie at j lifts the counter to its
    own plus 1, which then goes on by 1: L_i = i + max over j <= i of (x_j - j + 1), where
    x_j is the remote counter in a tie and the run's start counts as -1.
    """
    rows = _greatest(rows, F.greatest(F.col(now), F.coalesce(remote_phys, now)), clock, order)
    run = Window.partitionBy(clock, "hlc_phys").orderBy(order)
    rows = rows.withColumn("__i", F.row_number().over(run) - 1)
    tie = F.when(F.col(remote_phys) == F.col("hlc_phys"), F.col(remote_logical))
    x = F.greatest(tie, F.when(F.col("__i") == 0, -1))
    lifted = F.max(x - F.col("__i") + 1).over(run.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("hlc_logical", (F.col("__i") + lifted).cast("int")).drop("__i")


def last(rows: DataFrame, clock: str) -> DataFrame:
    """Each clock's last timestamp."""
    return rows.groupBy(clock).agg(F.max(F.struct("hlc_phys", "hlc_logical")).alias("t")).select(clock, "t.*")


def rendered(phys: str, logical: str, node: str) -> Column:
    return F.concat_ws(":", F.col(phys).cast("string"), F.col(logical).cast("string"), F.col(node))
