"""Base counts and scores against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.llm import quality, registry


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    d = f"/root/testdata/{sf}"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = registry.op6_quality(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == base(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_labels(spark):
    d = "/root/testdata/sf0.1"
    rows = registry.op6_quality(spark, d).where("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    got = {r["quality"]: r["kept"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert got[1] > 0.99 and got[0] < 0.1


def test_scores(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "d|", "é"]) for _ in range(rng.randrange(9)))) for i in range(40)]
    df, good = spark.createDataFrame(docs, "doc_id long, text string"), {i for i, _ in docs if i % 3 == 0}
    trusted = spark.createDataFrame([(i,) for i in [*good, *good, 999]], "doc_id long")
    grams = {}
    hashed = df.select("doc_id", F.split("text", " ").alias("w"))
    hashed = hashed.select("doc_id", F.transform(F.filter("w", lambda x: x != ""), lambda x: F.xxhash64(x)).alias("h"))
    for r in hashed.select("doc_id", F.transform("h", lambda x: F.pmod(x, F.lit(quality.BUCKETS))).alias("one"), F.transform("h", lambda x, i: F.pmod(F.xxhash64(x, F.get("h", i + 1)), F.lit(quality.BUCKETS))).alias("two")).collect():
        grams[r["doc_id"]] = [*r["one"], *r["two"]]
    raw, target = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    for i, g in grams.items():
        for b in g:
            raw[b] += 1
            target[b] += i in good
    prior, n, m = quality.PRIOR * quality.BUCKETS, sum(raw) + quality.BUCKETS, sum(target)
    table = [math.log((t + prior * (r + 1) / n) / (m + prior) / ((r + 1) / n)) for r, t in zip(raw, target, strict=True)]
    assert quality.ratios(df, trusted) == pytest.approx(table)
    for r in quality.quality(df, trusted).collect():
        g = grams[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(table[b] for b in g) / max(1, len(g)))


def test_edges(spark):
    docs = [(1, None), (2, ""), (None, "a b c"), (3, "a b c a b c\n\n \na b c a b c\n"), (3, "x"), (4, "long text here " * 30000), (5, "\x0b\x0c\x85  x y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    for trusted in (df.select("doc_id"), df.select("doc_id").where("false")):
        rows = quality.quality(df, trusted).collect()
        assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(base(t) for _, t in docs)
    assert quality.quality(df.where("false"), df.select("doc_id").where("false")).count() == 0
