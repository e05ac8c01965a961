"""Mixing sources to target weights by Pfair scheduling.

Time is a line of slots, each for one block of rows of one source.  A source
with weight w of D gets for its block k the release floor(k D / w) and the
deadline ceil((k + 1) D / w); earliest deadline first meets them all, so at
every slot each source is less than one block from its share.  Weights are exact
fractions and never rounded.  The driver makes one entry for each block, and
every row finds its block's entry by its rank.  When a source runs out, the rest go
on under a new schedule with their weights scaled up; there are as many schedules
as sources, of any number.  A target of none or 0 counts as 1e-9.  Blocks have 32 rows, or as many as
keep the schedule, which goes to all executors, to 2**20 blocks and one for each source.

Defined results: every row is kept once; null and empty source are one source; ranks within a
source follow a hash of the id, so they do not depend on partitions; ids that repeat are
ranked apart, by a hash of the row; ties of deadlines go to the lesser source; texts of any length, null
ones too, are carried along, as are other columns, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, functions as F

from tideline.llm._numbering import numbered

BLOCK_ROWS = 32
#: Blocks of a schedule, about, at most.
MOST_BLOCKS = 1 << 20
#: Slots of a stretch of `plan`; no result depends on it.
PERIOD = 1000


def shares(targets: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots of a period for each source, at least one: largest remainders first."""
    total, spare = sum(targets.values()), period - len(targets)
    exact = {s: spare * w / total for s, w in sorted(targets.items())}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def edf(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks within one period, by earliest deadline first."""
    period = sum(weights.values())
    by_release: list[list] = [[] for _ in range(period)]
    for s, w in weights.items():
        for k in range(w):
            by_release[k * period // w].append((-(-(k + 1) * period // w), s))
    ready: list[tuple[int, str]] = []
    out: dict[str, list[int]] = {s: [] for s in weights}
    for slot in range(period):
        for x in by_release[slot]:
            heapq.heappush(ready, x)
        deadline, s = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a block missed its deadline")
        out[s].append(slot)
    return out


def exact(targets: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    parts = {s: Fraction(w) for s, w in targets.items()}
    scale = math.lcm(*(x.denominator for x in parts.values()))
    return {s: int(x * scale) for s, x in parts.items()}


def scheduled(blocks: dict[str, int], targets: dict[str, float]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, phase, slot, release, deadline), slot by slot, by the exact weights."""
    left = {s: n for s, n in sorted(blocks.items()) if n}
    done, slot, phase = dict.fromkeys(left, 0), 0, 0
    weights = exact({s: targets[s] for s in left}) if left else {}
    while left:
        start, total = slot, sum(weights[s] for s in left)
        # Of each source only its next block waits: until its release, then by deadline.
        waiting = [(start, s, 0) for s in left]
        ready: list[tuple[int, str, int, int]] = []
        while True:
            while waiting and waiting[0][0] <= slot:
                release, s, k = heapq.heappop(waiting)
                heapq.heappush(ready, (start - (-(k + 1) * total // weights[s]), s, k, release))
            deadline, s, k, release = heapq.heappop(ready)
            if deadline <= slot:
                raise AssertionError("a block missed its deadline")
            yield s, done[s], phase, slot, release, deadline
            slot += 1
            done[s] += 1
            left[s] -= 1
            if not left[s]:  # the rest go on under a new schedule
                del left[s]
                break
            heapq.heappush(waiting, (start + (k + 1) * total // weights[s], s, k + 1))
        phase += 1


def plan(blocks: dict[str, int], targets: dict[str, float], period: int = PERIOD) -> list[tuple]:
    """Rows (source, phase, first block, end, first slot, share, period, slots of a period): the
    schedule in stretches of at most `period` slots, each of one phase."""
    out: dict[tuple, list] = {}
    starts: dict[int, int] = {}
    for s, block, phase, slot, _, _ in scheduled(blocks, targets):
        start = starts.setdefault(phase, slot)
        start += (slot - start) // period * period
        out.setdefault((start, s), [s, phase, block, start, []])[4].append(slot - start)
    return [(s, phase, first, first + len(x), start, len(x), period, x) for s, phase, first, start, x in out.values()]


#: Blocks of a source in one row of the table that goes to the executors.
CHUNK = 256
CHUNKS = "s string, chunk long, places array<struct<phase:int,slot:long,release:long,deadline:long>>"


def _chunks(blocks: dict[str, int], targets: dict[str, float]) -> Iterator[tuple]:
    held: dict[str, list] = {}
    for s, block, *place in scheduled(blocks, targets):
        held.setdefault(s, []).append(tuple(place))
        if block % CHUNK == CHUNK - 1 or block == blocks[s] - 1:
            yield s, block // CHUNK, held.pop(s)


def _scheduled(rows: DataFrame, targets: dict[str, float] | None, alpha: float, block_rows: int | None) -> DataFrame:
    """rows: __s (source), __id and more; adds rank, block, phase, release, deadline and slot."""
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy("__s").count().collect()}
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(counts.values()) // MOST_BLOCKS))
    weight = {s: float((targets or {}).get(s, 0) if targets else n**alpha) or 1e-9 for s, n in counts.items()}
    table = list(_chunks({s: -(-n // block_rows) for s, n in counts.items()}, weight))
    rows = numbered(rows, "__s", [F.xxhash64("__id"), F.col("__id")], "__rank")
    rows = rows.withColumn("__block", F.floor(F.col("__rank") / block_rows).cast("long"))
    places = spark.createDataFrame(table, CHUNKS, verifySchema=False)  # about 28 bytes for each block
    rows = rows.join(F.broadcast(places), (F.col("__s") == F.col("s")) & (F.floor(F.col("__block") / CHUNK) == F.col("chunk")))
    rows = rows.withColumn("__at", F.element_at("places", (F.col("__block") % CHUNK + 1).cast("int")))
    return rows.withColumns({"phase": F.col("__at.phase"), "__slot": F.col("__at.slot"), "__release": F.col("__at.release"), "__deadline": F.col("__at.deadline")}).drop("places", "__at")


def schedule(documents: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, block_rows: int | None = None, period: int = PERIOD) -> DataFrame:
    """Per document its place in the mix: doc_id, source, source_rank, block, phase, release, deadline, slot.

    targets: weight by source; without it, the count of documents to the power alpha.
    period has no effect, for schedules are exact over their whole length.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__s"))
    out = _scheduled(rows, targets, alpha, block_rows)
    return out.select(F.col("__id").alias("doc_id"), F.col("__s").alias("source"), F.col("__rank").alias("source_rank"), F.col("__block").alias("block"), "phase", F.col("__release").alias("release"), F.col("__deadline").alias("deadline"), F.col("__slot").alias("slot"))


def mixed(documents: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, block_rows: int | None = None, period: int = PERIOD) -> DataFrame:
    """The documents in the order of the mix, with their own columns only."""
    rows = documents.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__s"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"))
    out = _scheduled(rows, targets, alpha, block_rows)
    return out.orderBy("__slot", "__rank").select("__row.*")
