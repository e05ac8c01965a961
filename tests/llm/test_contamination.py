"""Contamination against windows looked up in every text."""

import hashlib
import random
import re

import numpy as np
import pytest

from tideline.llm import _tokens as tk
from tideline.llm import contamination

DOCS, BENCH = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench):
    windows = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, bench):
    return sorted((tuple(r) for r in contamination.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)).collect()), key=str)


def test_random(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(["a", "b", "É", "c9", "dd"]) for _ in range(n))
    bench = [(i, text(rng.choice([1, 2, 3, 5, 12, 13, 14, 30]))) for i in range(3, 14)] + [(50, None), (51, "--"), (52, ""), (3, "zz a zz")]
    docs = [(i, text(rng.randrange(60)) + " " + (rng.choice(bench)[1] or "").upper() + " " + text(rng.randrange(9))) for i in range(80)]
    assert run(spark, docs, bench) == brute(docs, bench)
    bench = [(i, t) for i, t in bench if t and len(words(t)) > 11]
    assert run(spark, docs, bench) == brute(docs, bench)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet").collect()]
    want = brute(docs, bench)
    assert run(spark, docs, bench) == want and any(r[5] for r in want)


def test_edges(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, None), (2, ""), (None, item), (3, item + " x" * 40000), (3, item)]
    assert run(spark, docs, [(1, item)]) == brute(docs, [(1, item)])
    assert run(spark, docs, []) == brute(docs, []) and run(spark, [], [(1, item)]) == []
    df = spark.createDataFrame([(1, "n", item, True), (2, "n", "clean", False)], "doc_id long, n_words string, text string, contaminated boolean")
    kept = contamination.decontaminate(df, spark.createDataFrame([(1, item)], BENCH))
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [2]


def test_blocks(spark, monkeypatch):
    rng = random.Random(5)
    bench = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(20))) for i in range(12)]
    docs = [(i, " ".join(b[1] for b in rng.sample(bench, 2))) for i in range(20)]
    monkeypatch.setattr(contamination.blocks_of, "__defaults__", (13, 250))
    assert run(spark, docs, bench) == brute(docs, bench)


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "a b " + " ".join(f"w{i}" for i in range(5, 25)) + " c"), (2, item), (3, "x " + " ".join(f"w{i}" for i in range(14)))]
    got = contamination.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item)], BENCH)).collect()
    assert {tuple(r) for r in got} == {(1, 2, "7", 5, 20), (2, 0, "7", 0, 30), (3, 1, "7", 0, 14)}
    assert tk.SLICE_BYTES


def test_suffix_array():
    rng = random.Random(8)
    for _ in range(40):
        words = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 60))])
        cuts = sorted({0, *(rng.randrange(len(words)) for _ in range(rng.randrange(5)))})
        ends = np.repeat([*cuts[1:], len(words)], np.diff([*cuts, len(words)]))
        suffix = lambda i: words[i : ends[i]].tolist()
        got = contamination.suffix_array(words, ends, len(words)).tolist()
        assert got == sorted(range(len(words)), key=lambda i: (suffix(i), i))
        tests = np.arange(max(0, len(words) - 3))
        lo, hi = (contamination.bound(words, ends, np.array(got), words, tests, 4, after) for after in (False, True))
        for t in tests.tolist():
            window = words[t : t + 4].tolist()
            assert sorted(got[lo[t] : hi[t]]) == [i for i in range(len(words)) if suffix(i)[:4] == window]


def test_all_longest_matches(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("ab" if n % 2 else "abcde") for _ in range(n))
    bench = [(i, text(rng.choice([2, 7, 12, 13, 14, 25, 40]))) for i in range(9)] + [(20, "a " * 30)]
    docs = [(i, text(rng.randrange(70)) + " zz " + rng.choice(bench)[1]) for i in range(30)] + [(99, "a " * 50)]
    want = set()
    for d, t in docs:
        for i, item in bench:
            a, b = words(t), words(item)
            for x in range(len(a)):
                for y in range(len(b)):
                    if x and y and a[x - 1] == b[y - 1]:
                        continue
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    if n >= min(13, len(b)):
                        want.add((d, x, str(i), y, n))
    got = [tuple(r) for r in contamination.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)).collect()]
    assert set(got) == want and len(got) == len(want)
