"""Components against all pairs of sets."""

import random
import re

import pyarrow as pa
import pytest

from tideline.llm import jaccard

SCHEMA = "doc_id long, text string"


def brute(rows):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return frozenset()
        return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) > 2 else frozenset([tuple(words)])

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a]) < 90 * len(sets[b]):
                break
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 90 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in sets)


def run(spark, rows):
    return sorted(tuple(r) for r in jaccard.components(spark.createDataFrame(rows, SCHEMA)).collect())


def test_copies_of_copies(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    rows, base = [], [word() for _ in range(120)]
    for i in range(160):
        if i % 8 == 0:
            base = [word() for _ in range(rng.choice([9, 10, 11, 14, 15, 21, 60, 200]))]
        if i % 3 == 0 and i % 8:
            base = list(base)
            base[rng.randrange(len(base))] = word()  # a chain that walks away from where it began
        text = list(base)
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(len(text))] = word()
        if rng.random() < 0.3:
            text = text[: rng.randrange(len(text) - 2, len(text) + 1)]
        rows.append((i * 7 % 1009, " ".join(text).upper() if i % 5 == 0 else "\n".join(text)))
    assert run(spark, rows) == brute(rows)


def test_one_large_group(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, "é é é"), (9, "é é é")]
    rows += [(20, "long " * 30000 + "tail"), (21, "long " * 30000 + "tail"), (22, "long " * 30000 + "Tail")]
    assert run(spark, rows) == brute(rows)
    got = run(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c")])
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert jaccard.components(spark.createDataFrame([(None, "a b c"), (3, "a b c")], SCHEMA)).where("doc_id is null").first()["component_id"] is None
    assert run(spark, []) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    got = sorted(tuple(r) for r in jaccard.components(docs).collect())
    assert got == brute([tuple(r) for r in docs.collect()])


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d", None, 1), (3, "A b c d", "x", 2), (3, "a b c d", "x", 2), (None, "a b c d", "x", 3), (None, None, None, None), (9, None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, a int")
    kept = jaccard.deduplicated(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["a"]) for r in kept.collect()), key=str)
    assert got == sorted([(3, 2), (None, 3), (None, None), (9, 4)], key=str)


def test_many_large_sets(spark):
    """Sets of a thousand shingles, of which some have empty groups: no gathering holds them all."""
    rng = random.Random(8)
    rows = []
    for i in range(0, 120, 3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
        rows.append((i, " ".join(base)))
        for k in (1, 2):
            base[rng.randrange(1000)] = f"x{rng.randrange(10**6)}"
            rows.append((i + k, " ".join(base[: 1000 - 5 * k])))
    assert run(spark, rows) == brute(rows)
    empty = [(jaccard.group_sums(s, 170)[1] == 0).sum() for s in jaccard.sets(pa.array([t for _, t in rows]))]
    assert max(empty) > 0
    lists = jaccard._gathered(jaccard._prints(spark.createDataFrame(rows, SCHEMA), 4), jaccard.BLOCK)
    assert max(len(r["members"]) // 8 for r in lists.collect()) <= 3


def test_rows_of_one_id_are_one_document(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    got = run(spark, [(5, x), (5, y), (2, x), (9, y), (7, z), (9, z)])
    assert {(i, c) for i, _, c in got} == {(5, 2), (2, 2), (9, 2), (7, 2)}


def test_no_text_is_lost(spark):
    rows = [(1, "a b c d e", 0, 0), (4, "p q r s", 1, 0), (4, "P  q r S", 1, 0), (4, "other words here", 2, 0), (4, "other words here", 2, 0)]
    kept = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, __maybe int, row int"))
    assert sorted((r["doc_id"], r["text"], r["__maybe"]) for r in kept.collect()) == [(1, "a b c d e", 0), (4, "P  q r S", 1), (4, "other words here", 2)]


def test_large_gatherings_in_parts(spark):
    """Near copies, several families of them that share half of their words, and strangers with one line."""
    rng = random.Random(10)
    common, rows = [f"c{i}" for i in range(200)], []
    for family in range(3):
        base = common + [f"f{family}x{i}" for i in range(30 + 20 * family)]
        for _ in range(70):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    rows += [(2000 + i, " ".join([f"s{i}y{k}" for k in range(9)] + common[:14])) for i in range(60)]
    for block in (8, 40, 4096):
        got = sorted(tuple(r) for r in jaccard.components(spark.createDataFrame(rows, SCHEMA), block).collect())
        assert got == brute(rows), block
