"""Gradients against differences, windows against a loop, and held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import _tokens as tk
from tideline.llm import registry, toxicity


def test_gradients():
    net = toxicity.Network(1)
    v = toxicity.Vocabulary(*tk.buffers(pa.array(["the cat sat on the mat " * 9, "a dog", "over and over again"])))
    rows, doc, _ = v.windows()
    marks = np.array([1, 0, 1], np.float32)[doc]
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    g, loss = net.gradients(v, rows, marks)
    rng = np.random.default_rng(2)
    for name, w in net.w.items():
        d = g[name]
        if isinstance(d, tuple):
            whole = np.zeros_like(w)
            np.add.at(whole, d[0], d[1])
            d = whole
            picks = [(int(i), int(rng.integers(w.shape[1]))) for i in rng.choice(np.flatnonzero(np.abs(d).sum(1)), 4)]
        else:
            picks = [tuple(int(rng.integers(n)) for n in w.shape) for _ in range(4)]
        for at in picks:
            old, eps = w[at], 1e-3
            w[at] = old + eps
            up = net.gradients(v, rows, marks)[1]
            w[at] = old - eps
            down = net.gradients(v, rows, marks)[1]
            w[at] = old
            assert abs((up - down) / (2 * eps) - d[at]) < 2e-4 + 0.05 * abs(d[at]), (name, at)


def test_windows_cover_all_words():
    texts = ["", "a", " ".join(f"w{i}" for i in range(toxicity.WINDOW)), " ".join(f"w{i}" for i in range(toxicity.WINDOW + 1)), "x " * 1000, None]
    v = toxicity.Vocabulary(*tk.buffers(pa.array(texts, pa.string())))
    rows, doc, where = v.windows()
    assert list(np.diff(where)) == [0, 1, 1, 2, 42, 0]
    for d, t in enumerate(texts):
        n = len((t or "").split())
        assert n == 0 or sorted({k * toxicity.STRIDE + j for k in range(where[d + 1] - where[d]) for j in range(toxicity.WINDOW) if rows[where[d] + k, j] >= 0}) == list(range(n))


def test_slices_make_no_difference(monkeypatch):
    texts = [f"word{i} again and again {i % 7} ends" * (i % 5) for i in range(60)]
    net = toxicity.Network(3)
    a = net.scores(pa.array(texts))
    monkeypatch.setattr(tk, "SLICE_BYTES", 100)
    monkeypatch.setattr(tk.slices, "__defaults__", (100,))
    assert np.allclose(a, net.scores(pa.array(texts)), atol=1e-6)
    v, w = toxicity.Vocabulary(*tk.buffers(pa.array(texts))), None
    monkeypatch.undo()
    w = toxicity.Vocabulary(*tk.buffers(pa.array(texts)))
    assert sorted(v.words) == sorted(w.words) and len(v.at) == len(w.at) and (np.diff(v.offs) == np.diff(w.offs)).all()


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in registry.op5_toxicity(spark, d).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == 10000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [i for i in marks if got[i]["held_out"]]
    hit = np.mean([got[i]["predicted"] == marks[i] for i in held])
    recall = np.mean([got[i]["predicted"] for i in held if marks[i]])
    assert hit > 0.95 and recall > 0.85


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x y", 5), (3, "w " * 50000, 5), (3, "w " * 50000, 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {toxicity.EMPTY}
    one = spark.createDataFrame([(1, 1, 1), (1, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, one).collect()} <= {0.0, 1.0, toxicity.EMPTY}
    assert toxicity.cleaned(docs, none).columns == docs.columns and toxicity.cleaned(docs, none).count() == 5
    assert toxicity.toxicity(docs.where("false"), none).count() == 0
    net = toxicity.train(["bad words here", "good words here"] * 20, [1, 0] * 20)
    s = net.scores(pa.array([None, "", "bad words here", "good words here"]))
    assert list(s[:2]) == [toxicity.EMPTY] * 2 and s[2] > 0.5 > s[3]
    assert pytest.approx(s[2]) == net.scores(pa.array(["bad words here"]))[0]


def test_scores_against_a_plain_network():
    """Windows one by one, word by word, as the gates are written down in books."""
    rng = np.random.default_rng(5)
    net = toxicity.Network(3)
    words = [f"w{rng.integers(40)}{'abc'[rng.integers(3)] * rng.integers(6)}" for _ in range(150)]
    texts = [" ".join(words[: rng.integers(1, 150)]) for _ in range(20)] + ["one", "a b", "É z " * 40]
    v = toxicity.Vocabulary(*toxicity.tk.buffers(pa.array(texts)))
    inputs = net.inputs(v).astype(np.float64)
    w = {k: x.astype(np.float64) for k, x in net.w.items()}
    sigmoid, h = lambda x: 1 / (1 + np.exp(-x)), toxicity.HIDDEN

    def states(x, d):
        s, out = np.zeros(h), []
        for row in x if d == "f" else x[::-1]:
            g = row @ w[f"{d}wx"] + w[f"{d}b"]
            zr = sigmoid(g[: 2 * h] + s @ w[f"{d}u"])
            n = np.tanh(g[2 * h :] + (zr[h:] * s) @ w[f"{d}v"])
            s = (1 - zr[:h]) * n + zr[:h] * s
            out.append(s)
        return out if d == "f" else out[::-1]

    want = []
    for i in range(len(texts)):
        at, best = v.at[v.offs[i] : v.offs[i + 1]], -np.inf
        for start in range(0, max(1, len(at) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            x = inputs[at[start : start + toxicity.WINDOW]]
            both = np.concatenate([states(x, "f"), states(x, "g")], axis=1)
            a = np.exp(np.tanh(both @ w["a"]) @ w["q"])
            best = max(best, (a / a.sum()) @ both @ w["o"] + w["c"][0])
        want.append(sigmoid(best))
    assert np.allclose(net.scores(pa.array(texts)), want, atol=1e-4)
