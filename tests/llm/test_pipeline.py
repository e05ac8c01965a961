"""The pipeline's stages, each against plain Python on its own input."""

import re
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from tests.llm import test_contamination, test_jaccard
from tideline.llm import mixing, toxicity

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {"start": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        assert docs.columns[: len(columns)] == columns and (docs.columns == columns or name == "sharding")
    by_id = {r["doc_id"]: tuple(r) for r in rows["start"]}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "contamination", "mixing", "sharding"]
    for n in names:
        assert all(by_id[r["doc_id"]] == tuple(r)[: len(columns)] for r in rows[n]) and len({r["doc_id"] for r in rows[n]}) == len(rows[n])

    model = toxicity.model_of(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.scores(pa.array([r["text"] for r in rows["start"]]))
    ids = lambda n: {r["doc_id"] for r in rows[n]}
    assert ids("toxicity") == {r["doc_id"] for r, s in zip(rows["start"], scores, strict=True) if s < toxicity.THRESHOLD}
    classes = test_jaccard.brute([(r["doc_id"], r["text"]) for r in rows["toxicity"]])
    assert ids("near_duplicates") == {i for i, _, c in classes if i == c}
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = test_contamination.brute([(r["doc_id"], r["text"]) for r in rows["near_duplicates"]], bench)
    assert ids("contamination") == {r[0] for r in judged if not r[5]}
    assert ids("mixing") == ids("contamination") == ids("sharding")
    plan = mixing.schedule(spark.read.parquet(str(tmp_path / "contamination"))).collect()
    place = {r["doc_id"]: (r["slot"], r["source_rank"]) for r in plan}
    files = sorted((tmp_path / "mixing").glob("part-*"), key=lambda p: int(re.search(r"part-(\d+)", p.name)[1]))
    order = [r["doc_id"] for f in files for r in spark.read.parquet(str(f)).select("doc_id").toLocalIterator()]
    assert order == sorted(place, key=place.get)
    slots = {}
    for r in rows["sharding"]:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(40))


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns[-2:] == ["shard", "slot"] and Counter(r["doc_id"] for r in got.collect()).most_common(1)[0][1] == 1


def test_shards_follow_the_mix(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = corpus_pipeline.mixed(spark, docs, SF)
    mix.write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "mixing"))
    got = corpus_pipeline.sharded(spark, spark.read.parquet(str(tmp_path / "mixing")), SF).collect()
    place = {r["doc_id"]: (r["slot"], r["source_rank"]) for r in mixing.schedule(docs).collect()}
    shards = {}
    for r in sorted(got, key=lambda r: r["slot"]):
        shards.setdefault(r["shard"], []).append((r["slot"], place[r["doc_id"]]))
    assert len(got) == len(place) and len(shards) == 40
    for rows in shards.values():
        assert [s for s, _ in rows] == list(range(len(rows))) and [p for _, p in rows] == sorted(p for _, p in rows)
