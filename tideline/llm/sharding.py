"""Sharding by a hierarchical weighted hash tree.

A document descends from the root over regions and racks to a shard.  At each
node every child draws -ln(u) / weight from a hash of the document's id and the
child's place, and the least draw wins, so a child gets its share of the weight
and a change of one weight moves documents only into or out of that child.

A shard that is added later stands in a region and a rack (see `places`), and its weight is a
tranche of its own at both: a region's draw is the least of those of its first weight and of its
tranches, and where a tranche wins the descent goes straight to the shard that brought it.  So an
added shard takes exactly the documents whose draw it wins, however often shards are added.
(Raising the weights of its region and rack instead would move documents into their old shards as well.)

Defined results: id and shard count alone decide (law `key`), so equal ids, null
included, share a shard; null texts count as empty, texts of any length are measured whole; order of slots
is by hash, then id, then a hash of the row; ties of draws go to the lesser child; rows that repeat
each get a slot; other columns are carried along by `assign`, whatever their names, but for shard and slot;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm._numbering import numbered

SHARDS = 40


def tree_of(weights: list[float], racks_per_region: int = 2, shards_per_rack: int = 5) -> list[list[list[tuple[int, float]]]]:
    """Regions of racks of (shard, weight), filled in order."""
    shards = list(enumerate(weights))
    racks = [shards[i : i + shards_per_rack] for i in range(0, len(shards), shards_per_rack)]
    return [racks[i : i + racks_per_region] for i in range(0, len(racks), racks_per_region)]


def places(weights: list[float], added: list[float] = (), racks_per_region: int = 2, shards_per_rack: int = 5) -> list[tuple[int, int, int]]:
    """(shard, region, rack) of every shard; an added one goes to the rack with the least weight,
    tranches included, the first of equal ones."""
    tree = tree_of(weights, racks_per_region, shards_per_rack)
    load = {(r, q): sum(w for _, w in rack) for r, region in enumerate(tree) for q, rack in enumerate(region)}
    out = [(s, r, q) for r, region in enumerate(tree) for q, rack in enumerate(region) for s, _ in rack]
    for i, w in enumerate(added):
        r, q = min(load, key=lambda k: (load[k], k))
        load[r, q] += w
        out.append((len(weights) + i, r, q))
    return out


def _winner(key: Column, path: list[Column], weights: Column) -> Column:
    """The child with the least -ln(u) / weight; u: 53 bits of a hash; without weight none wins."""

    def draw(weight: Column, child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, *path, child), 11).cast("double")
        return F.struct(F.when(weight > 0, -F.log((bits + 0.5) / F.lit(float(1 << 53))) / weight).otherwise(F.lit(float("inf"))).alias("draw"), child.alias("child"))

    return F.array_min(F.transform(weights, draw))["child"]


def with_shard(df: DataFrame, key: str, name: str, weights: list[float], added: list[float] = (), **shape) -> DataFrame:
    """Adds `name`: the shard for a key column; `added` are the weights of shards that came later, in
    order, each a tranche of the region and rack that `places` gives it."""
    tree = tree_of(weights, **shape)
    total = lambda x: sum(map(total, x)) if isinstance(x, list) else x[1]
    racks = max(len(r) for r in tree)
    leaves = max(len(k) for r in tree for k in r)
    k = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    rack_w = F.lit([[float(total(r[i])) if i < len(r) else 0.0 for i in range(racks)] for r in tree])
    leaf_w = F.lit([[float(r[i][j][1]) if i < len(r) and j < len(r[i]) else 0.0 for j in range(leaves)] for r in tree for i in range(racks)])
    first = F.lit([r[i][0][0] if i < len(r) else 0 for r in tree for i in range(racks)])
    top = [float(total(r)) for r in tree]
    df = df.withColumn("__r", _winner(k, [F.lit("root")], F.lit([*top, *map(float, added)])))
    grown = F.col("__r") >= len(top)
    rack = F.col("__r") * racks + _winner(k, [F.lit("region"), F.col("__r")], F.get(rack_w, F.col("__r")))
    df = df.withColumn("__q", F.when(~grown, rack))
    leaf = F.get(first, F.col("__q")) + _winner(k, [F.lit("rack"), F.col("__q")], F.get(leaf_w, F.col("__q")))
    return df.withColumn(name, F.when(grown, F.col("__r") - len(top) + len(weights)).otherwise(leaf).cast("int")).drop("__r", "__q")


def shards(documents: DataFrame, n_shards: int = SHARDS, weights: list[float] | None = None) -> DataFrame:
    """Per document: size, text_crc32, law, shard, slot and grown_shard (with one shard more)."""
    weights = weights or [1.0] * n_shards
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = with_shard(rows, "doc_id", "shard", weights)
    rows = with_shard(rows, "doc_id", "grown_shard", weights, [1.0])
    out = numbered(rows, "shard", [F.col("doc_id"), F.col("text_crc32")], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def assign(documents: DataFrame, n_shards: int = SHARDS, weights: list[float] | None = None, in_files: bool = False) -> DataFrame:
    """The documents with `shard` and a gapless `slot`; columns of those names are replaced.

    in_files: slots follow the order of the rows in the files that `documents` is read from,
    by the number of the part, then the row; otherwise that of `numbered`.
    """
    weights = weights or [1.0] * n_shards
    kept = [c for c in documents.columns if c not in ("shard", "slot")]
    rows = documents.select(F.col("doc_id").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), *([F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at")] if in_files else []))
    rows = with_shard(rows, "__id", "__shard", weights)
    if in_files:
        part = F.regexp_extract("__file", r"^part-(\d+)", 1).try_cast("long")
        rows = numbered(rows, "__shard", [F.col("__at")], "__slot", F.struct(F.coalesce(part, F.lit(-1)), F.col("__file")))
    else:
        rows = numbered(rows, "__shard", [F.col("__id")], "__slot")
    return rows.select("__row.*", F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
