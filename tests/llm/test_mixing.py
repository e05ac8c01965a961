"""Schedules against their bounds."""

import math
import random
from collections import Counter
from fractions import Fraction


from tideline.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def test_deadlines_and_deviation():
    rng = random.Random(1)
    for _ in range(30):
        w = {f"s{i}": rng.randrange(1, 40) for i in range(rng.randrange(1, 12))}
        period, slots = sum(w.values()), mixing.edf(w)
        assert sorted(x for v in slots.values() for x in v) == list(range(period))
        for s, at in slots.items():
            for k, slot in enumerate(at):
                assert k * period // w[s] <= slot < math.ceil((k + 1) * period / w[s])
            for t in range(period + 1):
                assert abs(sum(x < t for x in at) - t * w[s] / period) < 1


def test_shares():
    got = mixing.shares({"a": 5.0, "b": 1e-9, "c": 5.0}, 100)
    assert sum(got.values()) == 100 and got["b"] >= 1 and abs(got["a"] - got["c"]) <= 1


def test_phases_take_every_block_once():
    rng = random.Random(2)
    for _ in range(20):
        blocks = {f"s{i}": rng.randrange(0, 400) for i in range(6)}
        rows = mixing.plan(blocks, {s: rng.random() + 0.01 for s in blocks}, 60)
        seen, used = {}, set()
        for s, _, first, end, start, share, period, slots in rows:
            for k in range(first, end):
                slot = start + (k - first) // share * period + slots[(k - first) % share]
                assert slot not in used and k not in seen.setdefault(s, {})
                used.add(slot)
                seen[s][k] = slot
        assert {s: len(x) for s, x in seen.items()} == {s: n for s, n in blocks.items() if n}
        assert used == set(range(sum(blocks.values())))  # no slot is idle
        assert all(x[k] < x[k + 1] for x in seen.values() for k in range(len(x) - 1))


def test_rows(spark):
    rng = random.Random(3)
    rows = [(i, "big" if i % 3 else rng.choice(["a", "b", "c", None, ""]), str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.schedule(df, block_rows=10, period=50).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    by = {}
    for r in got:
        assert r["block"] == r["source_rank"] // 10 and r["release"] <= r["slot"] < r["deadline"]
        by.setdefault(r["source"], []).append((r["slot"], r["source_rank"]))
    for places in by.values():
        assert [k for _, k in sorted(places)] == list(range(len(places)))
    assert set(by) == {"big", "a", "b", "c", ""}
    blocks = sorted({(r["slot"], r["source"]) for r in got})
    assert len(blocks) == len({s for s, _ in blocks})
    out = mixing.mixed(df, block_rows=10, period=50).collect()
    place = {r["doc_id"]: (r["slot"], r["source_rank"]) for r in got}
    assert [r["doc_id"] for r in out] == sorted(place, key=place.get)


def test_targets(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "if(id % 2 = 0, 'x', 'y') as source", "'t' as text", "1 as slot", "2 as period")
    got = mixing.schedule(df, {"x": 3, "y": 1}, block_rows=1, period=100).where("phase = 0").collect()
    for t in range(0, 2000, 37):
        assert abs(sum(r["slot"] < t and r["source"] == "x" for r in got) - 0.75 * t) < 1.5
    assert mixing.mixed(df, block_rows=7).columns == df.columns


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None), (1, "a", None), (1, "a", None)], SCHEMA)
    assert mixing.schedule(df).count() == 3 and mixing.mixed(df).count() == 3
    assert mixing.schedule(df.where("false")).count() == 0 and mixing.mixed(df.where("false")).count() == 0


def test_exact_targets_over_a_long_run():
    for n, targets in ((200_000, {"a": 0.4, "b": 0.3, "c": 0.15, "d": 0.1, "e": 0.05}), (20_000, {"big": 0.5, **{f"s{i}": 0.5 / 99 for i in range(99)}}), (5000, {f"s{i}": 1.0 for i in range(1500)})):
        total, seen = sum(targets.values()), dict.fromkeys(targets, 0)
        for s, block, phase, slot, release, deadline in mixing.scheduled(dict.fromkeys(targets, n), targets):
            if phase or slot == n:
                break
            assert release <= slot < deadline and block == seen[s]
            assert abs(seen[s] - slot * targets[s] / total) < 1 + 1e-6
            seen[s] += 1
            assert abs(seen[s] - (slot + 1) * targets[s] / total) < 1 + 1e-6
        assert all(abs(seen[s] - n * w / total) < 1 + 1e-6 for s, w in targets.items())


def test_many_sources(spark):
    df = spark.range(2400).selectExpr("id as doc_id", "concat('s', id % 1200) as source", "'t' as text")
    got = mixing.schedule(df, block_rows=1).collect()
    assert sorted(r["slot"] for r in got) == list(range(2400)) and all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def plain(counts, targets, block_rows):
    """A schedule by a plain reading: at every slot the released block with the earliest deadline."""
    left = {s: -(-n // block_rows) for s, n in counts.items() if n}
    out, slot, done = {}, 0, dict.fromkeys(left, 0)
    while left:
        start, total = slot, sum(Fraction(targets[s]) for s in left)
        given = dict.fromkeys(left, 0)
        while True:
            ready = []
            for s in left:
                rate = Fraction(targets[s]) / total
                k = given[s]
                release, deadline = start + math.floor(k / rate), start + math.ceil((k + 1) / rate)
                if release <= slot:
                    ready.append((deadline, s, release))
            deadline, s, release = min(ready)
            out[s, done[s]] = (slot, release, deadline)
            slot, given[s], done[s], left[s] = slot + 1, given[s] + 1, done[s] + 1, left[s] - 1
            if not left[s]:
                del left[s]
                break
    return out


def test_query_against_a_plain_schedule(spark):
    from tideline.llm import registry

    rows = registry.op3_mixing(spark, "/root/testdata/sf0.01").collect()
    counts = Counter(r["source"] for r in rows)
    want = plain(counts, {s: float(n**0.5) for s, n in counts.items()}, mixing.BLOCK_ROWS)
    ranks = {}
    for r in rows:
        assert (r["slot"], r["release"], r["deadline"]) == want[r["source"], r["source_rank"] // mixing.BLOCK_ROWS]
        ranks.setdefault(r["source"], []).append(r["source_rank"])
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())


def test_long_texts_and_large_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, "ab"[i % 2], "long " * 40000 if i % 500 == 0 else None, i) for i in range(2000)], "doc_id long, source string, text string, slot int")
    assert {(r["doc_id"], r["slot"], r["text"]) for r in mixing.mixed(df).collect()} == {(r["doc_id"], r["slot"], r["text"]) for r in df.collect()}
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 20)
    got = mixing.schedule(df).collect()
    assert max(r["slot"] for r in got) < 22 and all(r["block"] == r["source_rank"] // 100 for r in got)
