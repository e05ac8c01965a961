"""Quality rules: base counts, and a likelihood ratio of hashed n-grams.

Words and pairs of words are hashed into a fixed number of buckets.  Counts
over all documents give the raw multinomial, counts over trusted documents the
target one, smoothed towards the raw.  A document's score is the mean over its
n-grams of log(target / raw); one threshold judges every document.

DataFrame functions only.  The counts are summed before the shuffle, so what
moves is at most one row for each bucket and task, and the table of ratios has
one entry for each bucket, whatever the corpus.

Defined results: null text has no words; a text without words scores 0 and fails the base rule;
without trusted documents all ratios are 0; documents that repeat are judged alike and count each time;
texts of any length are read whole; a score on the threshold is kept; other columns are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 14
#: Weight of the raw multinomial in the target's smoothing, in n-grams for each bucket.
PRIOR = 1.0
#: Mean log ratio below which a document goes.
THRESHOLD = -0.05
#: Trusted ids that are sent to all tasks; more are joined by a shuffle.
MOST_IDS = 2_000_000

MIN_WORDS = 50


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x), with x computed once.  Named columns in between would be copied into one another
    when a filter on the result is pushed down, and grow beyond what the optimizer can handle."""
    return F.transform(F.array(x), body)[0]


def _hashes(text: Column) -> Column:
    """The hashes of a text's words."""
    return F.transform(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""), lambda w: F.xxhash64(w))


def _buckets(h: Column) -> Column:
    """The buckets of words and of pairs of words; the last pair lacks its second."""
    pairs = F.transform(h, lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(pairs, F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")))


def _repeated(h: Column) -> Column:
    """Words in windows of three that occur twice or more.  The last two windows are short, and
    equal to no other."""

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.get(s, k - 1)["w"].eqNullSafe(x["w"]) | F.get(s, k + 1)["w"].eqNullSafe(x["w"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def of(w: Column) -> Column:
        places = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), _let(places, covered)).otherwise(0)

    return _let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), of)


def ratios(documents: DataFrame, trusted: DataFrame) -> list[float]:
    """log(target / raw) of each bucket; documents and trusted have doc_id, documents text."""
    ids = trusted.select(F.col("doc_id").alias("__trusted")).where("__trusted is not null").distinct()
    if ids.limit(MOST_IDS + 1).count() <= MOST_IDS:
        ids = F.broadcast(ids)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("__trusted"), "left")
    grams = docs.select(F.col("__trusted").isNotNull().cast("int").alias("__good"), F.explode(_let(_hashes(F.col("text")), _buckets)).alias("b"))
    rows = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("__good").alias("target")).collect()  # one row for each bucket
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw) + BUCKETS, sum(target)
    prior = PRIOR * BUCKETS
    out = []
    for r, t in zip(raw, target, strict=True):
        p = (r + 1) / n_raw
        out.append(math.log((t + prior * p) / (n_target + prior) / p))
    return out


def quality(documents: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: n_words, base counts, base_failed, kept and score."""
    table = F.from_json(F.lit(json.dumps(ratios(documents, trusted))), "array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def measured(h: Column) -> Column:
        total = F.aggregate(_buckets(h), F.lit(0.0), lambda a, b: a + F.get(table, b))
        return F.struct(F.size(h).cast("long").alias("n_words"), _repeated(h).cast("long").alias("n_repeat_words"), (total / F.greatest(F.lit(1), 2 * F.size(h))).alias("score"))

    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), _let(_hashes(text), measured).alias("m"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    docs = docs.where(F.spark_partition_id() >= 0)  # always so; keeps filters on the result from computing all of it again
    docs = docs.select("doc_id", "m.*", "word_chars", "n_symbols", "n_dup_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
