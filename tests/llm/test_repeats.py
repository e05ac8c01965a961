"""Removed bytes against a table of all strings of 50 bytes."""

import hashlib
import random

import pytest

from tideline.llm import repeats

SCHEMA = "doc_id long, text string"


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - 49):
            s = t[p : p + 50]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(r) for r in repeats.removals(spark.createDataFrame(rows, SCHEMA)).collect())


def test_cut_copies(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé \n") for _ in range(3000))
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(6)):
            a = rng.randrange(len(base))
            parts.append(base[a : a + rng.choice([30, 44, 48, 49, 50, 51, 52, 60, 75, 120, 400])])
            parts.append("".join(rng.choice("xyzab") for _ in range(rng.randrange(30))))
        rows.append((rng.randrange(10**6) - 500_000, "".join(parts)))
    assert run(spark, rows) == brute(rows)


def test_runs_and_short_alphabets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "ab", "aab", "abcabd"]) * rng.randrange(40)) for i in range(40)]
    rows += [(100 + i, "".join(rng.choice("ab") for _ in range(rng.randrange(200)))) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_one_line_in_all(spark):
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    noise = lambda: "".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(80)))
    rows = [(i * 31 % 977, noise() + line[rng.randrange(5) : 90 - rng.randrange(5)] + noise()) for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 49), (5, "y" * 50), (6, "y" * 50), (7, "y" * 50)]
    assert run(spark, rows) == brute(rows)
    rows = [(2, "z" * 60 + "long " * 20000), (1, "long " * 20000), (3, "long " * 10)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    got = repeats.removals(spark.createDataFrame([(None, "q" * 80), (2, "q" * 80), (2, "q" * 80), (1, "q" * 80)], SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (2, 80), (2, 80)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(tuple(r) for r in repeats.removals(docs).collect()) == brute([tuple(r) for r in docs.collect()])


def test_groups_have_all_occurrences(spark):
    a, b = "".join(f"{i:03d}" for i in range(40)), "".join(f"{i:03d}" for i in range(500, 540))
    texts = {1: a + b, 2: "?" + a + "!", 3: "#" + a + b[:30] + "%", 4: "zz" + b + "y"}
    rows = repeats.repeat_groups(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["repeat"], r["length"]), []).append((r["doc_id"], r["start"]))
    assert groups
    for (_, n), places in groups.items():
        found = {texts[d][s : s + n] for d, s in places}
        assert len(found) == 1 and n >= 50
        (s,) = found
        assert all(any((d, p) in places for p in range(len(t)) if t.startswith(s, p)) for d, t in texts.items() if s in t and len(places) > 1)


def test_interval_tree():
    words = sorted(["banana$"[i:] for i in range(7)])
    lcp = [next(k for k in range(9) if words[i][k : k + 1] != words[i + 1][k : k + 1]) for i in range(6)]
    assert sorted(repeats.intervals(lcp)) == [(0, 0, 6), (1, 1, 3), (2, 5, 6), (3, 2, 3)]


def test_clashing_columns(spark):
    rows = [(1, "x" * 30 + "shared text of fifty bytes and a few more than that", 1, "a"), (2, "y" * 9 + "shared text of fifty bytes and a few more than that", 2, "b")]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.removals(spark.createDataFrame(rows, "doc_id long, text string, __maybe int, dbucket string")).collect()}
    assert got == {1: 0, 2: 51}
