"""Shares, movement and slots of the hash tree."""

import math
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tideline.llm import registry, sharding


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = registry.op2_shards(spark, d).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == texts.keys() and len(rows) == len(texts)
    slots = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key" and 0 <= r["shard"] < 40
        assert r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert registry.op2_shards(spark, d).orderBy("doc_id").collect() == sorted(rows, key=lambda r: r["doc_id"])


def test_shares_and_movement(spark):
    ids = spark.range(40000).select(F.col("id").alias("k"))
    old = [1.0, 2.0, 0.0, 3.0, 1.0, 1.0, 2.0]
    new = [1.0, 2.0, 0.0, 3.0, 1.0, 5.0, 2.0]
    shape = {"racks_per_region": 2, "shards_per_rack": 2}
    df = sharding.with_shard(ids, "k", "a", old, **shape)
    df = sharding.with_shard(df, "k", "b", new, **shape)
    df = sharding.with_shard(df, "k", "c", old, [2.0], **shape)
    rows = df.collect()
    n = Counter(r["a"] for r in rows)
    assert all(abs(n[s] - 40000 * w / 10) < 300 for s, w in enumerate(old))
    assert all(r["c"] in (r["a"], 7) for r in rows) and abs(sum(r["c"] == 7 for r in rows) - 40000 * 2 / 12) < 300
    # shard 5's weight grew: documents move into its region (4..6), or within it into 4 and 5's rack, or into 5
    region, rack = (lambda s: s // 4), (lambda s: s // 2)
    for r in rows:
        if r["a"] != r["b"]:
            assert region(r["b"]) == 1
            if region(r["a"]) == 1:
                assert rack(r["b"]) == 2
                if rack(r["a"]) == 2:
                    assert r["b"] == 5


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 9), (1, None, 9), (None, "x", 9), (None, "y", 9), (2, "long " * 50000, 9)], "doc_id long, text string, shard int")
    rows = sharding.shards(df).collect()
    assert len(rows) == 5 and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1 and {r["size"] for r in rows if r["doc_id"] == 1} == {16}
    out = sharding.assign(df)
    assert out.columns == ["doc_id", "text", "shard", "slot"] and out.count() == 5
    assert sharding.shards(df.where("false")).count() == 0
    one = sharding.shards(spark.range(5000).select(F.lit(7).alias("doc_id"), F.col("id").cast("string").alias("text"))).collect()
    assert sorted(r["slot"] for r in one) == list(range(5000)) and len({r["shard"] for r in one}) == 1


def _winner(key, path, weights):
    """The least -ln(u) / weight over children, by a plain reading of the hash."""
    best = None
    for child, w in enumerate(weights):
        h = 42
        for part in (key, *path, child):
            h = xxhash.xxh64_intdigest(part.encode() if isinstance(part, str) else part.to_bytes(4, "little"), seed=h)
        draw = -math.log(((h >> 11) + 0.5) / (1 << 53)) / w if w > 0 else math.inf
        if best is None or (draw, child) < best:
            best = (draw, child)
    return best[1]


def plain(key, n_shards, added=()):
    tree = sharding.tree_of([1.0] * n_shards)
    total = lambda x: sum(map(total, x)) if isinstance(x, list) else x[1]
    top = [float(total(r)) for r in tree]
    region = _winner(key, ["root"], [*top, *added])
    if region >= len(tree):
        return n_shards + region - len(tree)
    racks = max(len(r) for r in tree)
    weights = [float(total(k)) for k in tree[region]] + [0.0] * (racks - len(tree[region]))
    rack = _winner(key, ["region", region], weights)
    leaves = [w for _, w in tree[region][rack]]
    return tree[region][rack][_winner(key, ["rack", region * racks + rack], leaves)][0]


def test_query_against_a_plain_tree(spark):
    rows = registry.op2_shards(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 100
    for r in rows:
        assert (r["shard"], r["grown_shard"]) == (plain(str(r["doc_id"]), 40), plain(str(r["doc_id"]), 40, [1.0]))


def test_ties_keep_their_order(spark):
    df = spark.createDataFrame([(1, f"t{i % 7}", i) for i in range(500)], "doc_id long, text string, __whole int")
    a = {(r["text"], r["__whole"]): r["slot"] for r in sharding.assign(df).collect()}
    assert a == {(r["text"], r["__whole"]): r["slot"] for r in sharding.assign(df.repartition(9)).collect()} and sorted(a.values()) == list(range(500))


def test_growing_again_and_again(spark):
    ids = spark.range(20000).select(F.col("id").alias("k"))
    weights, df = [1.0] * 10, ids
    for n in range(4):
        df = sharding.with_shard(df, "k", f"s{n}", weights, [1.0] * n, racks_per_region=2, shards_per_rack=2)
    rows = df.collect()
    for n in range(1, 4):
        assert all(r[f"s{n}"] in (r[f"s{n - 1}"], 9 + n) for r in rows)
        assert abs(sum(r[f"s{n}"] == 9 + n for r in rows) - 20000 / (10 + n)) < 250
    at = sharding.places(weights, [1.0] * 3, 2, 2)
    assert [s for s, _, _ in at] == list(range(13)) and at[:4] == [(0, 0, 0), (1, 0, 0), (2, 0, 1), (3, 0, 1)]
    assert at[10:] == [(10, 0, 0), (11, 0, 1), (12, 1, 0)]
