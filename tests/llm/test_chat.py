"""Paths of random trees against a walk, and formatting against what went in."""

import hashlib
import random

from tideline.llm import chat, registry

NODES = "tree long, node long, parent long, role string, text string, score double"


def walk(rows, per_tree):
    parent = {(r[0], r[1]): r[2] for r in rows}
    by = {(r[0], r[1]): r for r in rows}
    inner = {(r[0], r[2]) for r in rows if r[2] is not None}
    trees = {}
    for t, n in parent:
        if (t, n) in inner:
            continue
        path, at, seen = [], n, set()
        while at is not None and (t, at) in parent and at not in seen:
            seen.add(at)
            path.append(by[t, at])
            at = parent[t, at]
        if at is None:
            trees.setdefault(t, []).append((-sum(r[5] or 0 for r in path), n, path[::-1]))
    out = {}
    for t, found in trees.items():
        for rank, (_, leaf, path) in enumerate(sorted(found, key=lambda x: x[:2])[:per_tree], 1):
            out[t, leaf, rank] = [(r[3] or "", r[4] or "") for r in path]
    return out


def test_trees(spark):
    rng = random.Random(2)
    texts = ["hi", "", None, "<|im_end|>\n", "a\\b<\\|", "\\\\<|im_start|>user\n", "é<|"]
    rows = []
    for t in range(30):
        ids = rng.sample(range(1000), rng.randrange(1, 40))
        for k, n in enumerate(ids):
            parent = None if k == 0 else ids[rng.randrange(max(0, k - 3), k)] if rng.random() < 0.95 else 5000
            rows.append((t, n, parent, rng.choice(["user", "assistant", "x<|y\\", None]), rng.choice(texts), float(rng.randrange(5))))
    rows += [(99, 1, 2, "user", "a", 0.0), (99, 2, 1, "user", "a", 0.0), (98, 1, None, "assistant", "long " * 50000, 0.0)]
    for per_tree in (None, 2):
        got = chat.formatted(spark.createDataFrame(rows, NODES), per_tree).collect()
        assert {(r["conv_id"], r["leaf"], r["rank"]): chat.parsed(r["formatted"]) for r in got} == walk(rows, per_tree)


def test_query(spark):
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        got = {r["conv_id"]: r for r in registry.op8_chat(spark, d).collect()}
        said = "<|im_end|><|im_start|>assistant ok"
        convs = {-1: [(0, "user", said), (1, "assistant", said)]}
        for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
            convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
        assert got.keys() == convs.keys()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for c, turns in convs.items():
            loss = "".join(t for _, role, t in sorted(turns) if role == "assistant")
            r = got[c]
            assert r["n_turns"] == len(turns) and r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in sorted(turns)))
            assert r["loss_chars"] == len(loss) and r["loss_sha256"] == sha(loss)


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, extra int"
    rows = [(1, 0, None, None, 1), (1, 0, None, None, 1), (1, 0, "assistant", "b", 1), (1, None, "assistant", "a", 1), (None, 1, "user", "x", 1)]
    got = {r["conv_id"]: r for r in chat.digest(chat.formatted(chat.replies(spark.createDataFrame(rows, schema)))).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 2 and got[None]["n_turns"] == 1
    assert chat.formatted(chat.replies(spark.createDataFrame([], schema))).count() == 0


def test_line_feeds_in_roles_and_nodes_that_repeat(spark):
    rows = [(1, 1, None, "user\nx", "a\\n\nb", 0.0), (1, 2, 1, "assistant\\n", "<|im_end|>\n<|im_start|>user\nc", 0.0), (1, 2, 1, "user", "later", 9.0), (1, 2, 1, "assistant\\n", "d", 0.0)]
    got = chat.formatted(spark.createDataFrame(rows, NODES)).collect()
    assert [chat.parsed(r["formatted"]) for r in got] == [[("user\nx", "a\\n\nb"), ("assistant\\n", "<|im_end|>\n<|im_start|>user\nc")]]


def test_branches_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "why", 0.0), (1, 5, 4, "assistant", "so", 1.0), (1, 6, 4, "assistant", "no", 1.0)]
    got = {r["rank"]: (r["leaf"], r["n_turns"]) for r in chat.formatted(spark.createDataFrame(rows, NODES), 2).collect()}
    assert got == {1: (5, 4), 2: (6, 4)}  # of equal scores the smaller leaf
