"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word goes in as the embedding of the word itself, beside the sum of embeddings of its
character n-grams (its beginnings and ends told apart).  A forward and a backward
GRU read windows of WINDOW words that overlap, attention pools each
window's states, and a logistic unit scores it.  A text's score is that of its
worst window, over all windows of the whole text.

The network is trained here in numpy, with Adam, on a sample of labelled rows:
first on windows drawn at random that carry their text's label, then on
the windows that decide: the worst of a toxic text, the worst few of a clean one.
The sample is bounded by SAMPLE and SAMPLE_BYTES; scores cover all text.

Defined results: null and empty texts have no window and get the score EMPTY; without labels of
both kinds every text gets the share of toxic ones; labels without id or mark are left out, and of
several marks of one id the largest counts; rows that repeat get the same score, whatever
their id; documents without id are scored and not held out; texts of any length are scored whole; a score
on the threshold counts as toxic; other columns are carried along or not looked at, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm import _tokens as tk

#: Most labelled texts to learn from, by mark, and the longest of them in bytes.
SAMPLE = {1: 2000, 0: 3000}
SAMPLE_BYTES = 8000
THRESHOLD = 0.3
EMPTY = 0.01

WINDOW, STRIDE = 32, 24
WORDS, CHARS = 1 << 13, 1 << 15
WIDTH, HIDDEN = 12, 8

DIGEST = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Vocabulary:
    """The distinct words of some texts: where they stand, and their inputs to the network.

    Texts are read in slices, whose words are then brought together.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        parts = [self._read(part, part_offs) for _, _, part, part_offs in tk.slices(data, offs)]
        names = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
        names, one, index = np.unique(names, return_index=True, return_inverse=True) if len(parts) > 1 else (names, np.arange(len(names)), np.arange(len(names)))
        self.words = (names % np.uint64(WORDS)).astype(np.int64)
        size = np.concatenate([p[3] for p in parts]) if parts else np.empty(0, np.int64)
        grams = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, np.int64)
        start = np.cumsum(size) - size
        n = size[one]
        self.first = np.append(0, np.cumsum(n))
        self.grams = grams[np.repeat(start[one] - self.first[:-1], n) + np.arange(int(n.sum()))]
        self.at, before, at = np.empty(0, np.int64), 0, []
        counts = [np.zeros(0, np.int64)]
        for p in parts:
            at.append(index[p[1] + before])
            before += len(p[0])
            counts.append(np.diff(p[4]))
        self.at = np.concatenate(at) if at else self.at
        self.offs = np.append(0, np.cumsum(np.concatenate(counts)))

    @staticmethod
    def _read(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of one slice: distinct words' hashes, the place of each word among them, their
        n-grams and the number of these, and the texts' offsets in words."""
        data = tk.lower(data)
        start, end, word_offs = tk.words(data, offs, tk.table("alnum"))
        if not len(start):
            return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)), word_offs
        hashes = tk.Hashes(data)
        names, one, at = np.unique(hashes.spans(start, end), return_index=True, return_inverse=True)
        s, e = start[one], end[one]
        parts = []
        for n in (3, 4, 5, 6):  # beginnings; a shorter word has none of this length
            has = np.flatnonzero(e - s >= n)
            parts.append((has, hashes.spans(s[has], s[has] + n) ^ np.uint64(n)))
        for n in (3, 4, 5):  # ends
            has = np.flatnonzero(e - s >= n)
            parts.append((has, hashes.spans(e[has] - n, e[has]) ^ np.uint64(n << 8)))
        count = np.maximum(0, e - s - 3)  # what lies between, by fours
        of = np.repeat(np.arange(len(s)), count)
        k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(s, count)
        parts.append((of, hashes.spans(k, k + 4) if len(k) else np.empty(0, np.uint64)))
        parts.append((np.arange(len(s)), names ^ np.uint64(1)))
        of = np.concatenate([p[0] for p in parts])
        order = np.argsort(of, kind="stable")
        grams = (tk.mix(np.concatenate([p[1] for p in parts])[order]) % np.uint64(CHARS)).astype(np.int64)
        return names, at, grams, np.bincount(of, minlength=len(s)), word_offs

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows, as rows of indices of words (-1: past the end), and their texts; and the
        offset of each text's windows."""
        size = np.diff(self.offs)
        n = np.where(size > 0, np.maximum(0, -(-(size - WINDOW) // STRIDE)) + 1, 0)
        doc = np.repeat(np.arange(len(size)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        at = (self.offs[:-1][doc] + k * STRIDE)[:, None] + np.arange(WINDOW)
        inside = at < self.offs[1:][doc][:, None]
        rows = np.where(inside, self.at[np.where(inside, at, 0)], -1).astype(np.int32) if len(doc) else np.empty((0, WINDOW), np.int32)
        return rows, doc, np.append(0, np.cumsum(n))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights, scores, and gradients by hand.

    word, char: embeddings; for each direction wx (input to gates z, r, n), b, u (state to z, r)
    and v (reset state to n); attention a, q; output o, c.
    """

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {"word": draw(WORDS, WIDTH, scale=0.1), "char": draw(CHARS, WIDTH, scale=0.1), "a": draw(2 * HIDDEN, HIDDEN, scale=0.4), "q": draw(HIDDEN, scale=0.4), "o": draw(2 * HIDDEN, scale=0.4), "c": np.zeros(1, np.float32)}
        for d in ("f", "g"):
            self.w |= {f"{d}wx": draw(2 * WIDTH, 3 * HIDDEN, scale=0.3), f"{d}b": np.zeros(3 * HIDDEN, np.float32), f"{d}u": draw(HIDDEN, 2 * HIDDEN, scale=0.3), f"{d}v": draw(HIDDEN, HIDDEN, scale=0.3)}

    def inputs(self, v: Vocabulary, some: np.ndarray | None = None) -> np.ndarray:
        """For each word (or some of them) the two embeddings side by side."""
        some = np.arange(len(v.words)) if some is None else some
        out = np.zeros((len(some), 2 * WIDTH), np.float32)
        if len(some):
            out[:, :WIDTH] = self.w["word"][v.words[some]]
            n = v.first[some + 1] - v.first[some]
            at = np.repeat(v.first[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out[:, WIDTH:] = np.add.reduceat(self.w["char"][v.grams[at]], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None].astype(np.float32)
        return out

    def _run(self, gates: np.ndarray, rows: np.ndarray, d: str, keep: bool):
        """States of one direction, time first; rows index the words' gate inputs."""
        h = np.zeros((len(rows), HIDDEN), np.float32)
        states, trace = np.empty((WINDOW, len(rows), HIDDEN), np.float32), []
        u, v = self.w[f"{d}u"], self.w[f"{d}v"]
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            here = (rows[:, t] >= 0)[:, None]
            x = gates[rows[:, t]]
            zr = x[:, : 2 * HIDDEN] + h @ u
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ v)
            new = np.where(here, n + z * (h - n), h)
            if keep:
                trace.append((t, here, h, z, r, n))
            h = states[t] = new
        return states, trace

    def logits(self, x: np.ndarray, rows: np.ndarray, keep: bool = False):
        """One number for each window; with what the gradients need."""
        gates = {d: np.clip(x @ self.w[f"{d}wx"] + self.w[f"{d}b"], -20, 20) for d in ("f", "g")}
        parts = {d: self._run(gates[d], rows, d, keep) for d in ("f", "g")}
        states = np.concatenate([parts["f"][0], parts["g"][0]], 2)
        e = np.tanh(states @ self.w["a"])
        s = np.where(rows.T >= 0, e @ self.w["q"], -1e9)
        s = np.exp(s - s.max(0))
        s /= s.sum(0)
        pooled = np.einsum("tb,tbk->bk", s, states)
        out = pooled @ self.w["o"] + self.w["c"]
        return (out, (parts, states, e, s, pooled)) if keep else out

    def gradients(self, v: Vocabulary, rows: np.ndarray, marks: np.ndarray) -> tuple[dict, float]:
        some, index = np.unique(rows, return_inverse=True)
        some, rows = (some[1:], index.reshape(rows.shape) - 1) if some[0] < 0 else (some, index.reshape(rows.shape))
        x = self.inputs(v, some)
        out, (parts, states, e, s, pooled) = self.logits(x, rows, keep=True)
        p = _sigmoid(out)
        loss = float(-np.mean(np.log(np.where(marks > 0, p, 1 - p) + 1e-7)))
        d_out = ((p - marks) / len(marks)).astype(np.float32)
        g = {"o": pooled.T @ d_out, "c": np.array([d_out.sum()], np.float32)}
        d_pooled = d_out[:, None] * self.w["o"]
        d_states = s[:, :, None] * d_pooled
        d_s = np.einsum("bk,tbk->tb", d_pooled, states)
        d_s = s * (d_s - (s * d_s).sum(0))
        g["q"] = np.einsum("tbh,tb->h", e, d_s)
        d_e = d_s[:, :, None] * self.w["q"] * (1 - e * e)
        g["a"] = np.einsum("tbk,tbh->kh", states, d_e)
        d_states += d_e @ self.w["a"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate(("f", "g")):
            u, w = self.w[f"{d}u"], self.w[f"{d}v"]
            du, dw, d_gates = np.zeros_like(u), np.zeros_like(w), np.zeros((len(x), 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(rows), HIDDEN), np.float32)
            for t, here, h, z, r, n in reversed(parts[d][1]):
                d_h = d_h + d_states[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                d_new = np.where(here, d_h, 0)
                d_n = d_new * (1 - z) * (1 - n * n)
                d_rh = d_n @ w.T
                d_zr = np.concatenate([d_new * (h - n) * z * (1 - z), d_rh * h * r * (1 - r)], 1)
                du += h.T @ d_zr
                dw += (r * h).T @ d_n
                at = np.flatnonzero(here[:, 0])
                np.add.at(d_gates, rows[at, t], np.concatenate([d_zr, d_n], 1)[at])
                d_h = np.where(here, d_new * z + d_rh * r + d_zr @ u.T, d_h)
            g |= {f"{d}u": du, f"{d}v": dw, f"{d}wx": x.T @ d_gates, f"{d}b": d_gates.sum(0)}
            d_x += d_gates @ self.w[f"{d}wx"].T
        g["word"] = (v.words[some], d_x[:, :WIDTH])
        n = v.first[some + 1] - v.first[some]
        at = np.repeat(v.first[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        g["char"] = (v.grams[at], np.repeat(d_x[:, WIDTH:] / np.sqrt(n)[:, None].astype(np.float32), n, axis=0))
        return g, loss

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each text: its worst window's."""
        data, offs = tk.buffers(texts)
        out = np.full(len(texts), EMPTY)
        for first, last, part, part_offs in tk.slices(data, offs):
            v = Vocabulary(part, part_offs)
            rows, _, where = v.windows()
            if not len(rows):
                continue
            x, got = self.inputs(v), np.empty(len(rows), np.float32)
            for i in range(0, len(rows), 4096):
                got[i : i + 4096] = self.logits(x, rows[i : i + 4096])
            has = np.flatnonzero(np.diff(where))
            out[first + has] = _sigmoid(np.maximum.reduceat(got, where[:-1][has]).astype(np.float64))
        return out


class Constant:
    """What stands in where there is nothing to learn from."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.full(len(texts), self.share)


class Adam:
    """Steps for dense weights and, row by row, for embeddings."""

    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.n = w, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in w.items()}
        self.s = {k: np.zeros_like(x) for k, x in w.items()}

    def step(self, g: dict) -> None:
        self.n += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, d in g.items():
            at = slice(None)
            if isinstance(d, tuple):
                at, index = np.unique(d[0], return_inverse=True)
                whole = np.zeros((len(at), d[1].shape[1]), np.float32)
                np.add.at(whole, index, d[1])
                d = whole
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * d
            s = self.s[k][at] = 0.999 * self.s[k][at] + 0.001 * d * d
            self.w[k][at] -= (scale * m / (np.sqrt(s) + 1e-8)).astype(np.float32)


def train(texts: list[str], marks: list[int], seed: int = 7, epochs: int = 8, rate: float = 0.01, batch: int = 128) -> Network | Constant:
    """A network for marked texts; the same for the same texts in the same order."""
    mark = np.array(marks, np.float32)
    if not len(mark) or mark.min() == mark.max():
        return Constant(float(mark.mean()) if len(mark) else EMPTY)
    rng, net = np.random.default_rng(seed), Network(seed)
    v = Vocabulary(*tk.buffers(pa.array(texts, pa.string())))
    rows, doc, where = v.windows()
    if not len(rows):
        return Constant(float(mark.mean()))
    has = np.flatnonzero(np.diff(where))
    adam = Adam(net.w, rate)
    short = max(1, -(-20 * batch // len(has)))  # few texts are gone through more often
    for epoch in range(epochs):
        chosen: list[np.ndarray] = []
        if epoch < 2:
            for _ in range(4):
                chosen.append(where[:-1][has] + (rng.random(len(has)) * np.diff(where)[has]).astype(np.int64))
        else:
            x = net.inputs(v)
            got = np.concatenate([net.logits(x, rows[i : i + 4096]) for i in range(0, len(rows), 4096)])
            order = np.lexsort((-got, doc))  # each text's windows, worst first
            rank = np.arange(len(order)) - where[doc[order]]
            chosen.append(order[rank == 0])
            chosen.append(order[(rank > 0) & (rank < 3) & (mark[doc[order]] == 0)])
        at = np.concatenate(chosen)
        for _ in range(short):
            rng.shuffle(at)
            for i in range(0, len(at), batch):
                part = at[i : i + batch]
                g, _ = net.gradients(v, rows[part], mark[doc[part]])
                adam.step(g)
        adam.rate = rate * (1 - epoch / epochs) ** 0.5
    return net


def sample(documents: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """At most SAMPLE labelled texts that aren't held out, of at most SAMPLE_BYTES, by a hash of the id."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__mark")).where(~held_out(F.col("doc_id")))
    ids = None
    for mark, most in SAMPLE.items():
        some = marks.where(F.col("__mark") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("__id"), "__mark")
        ids = some if ids is None else ids.unionByName(some)
    rows = documents.select(F.col("doc_id").alias("__doc"), "text").where(f"octet_length(text) <= {SAMPLE_BYTES}").join(F.broadcast(ids), F.col("__doc") == F.col("__id"))
    found = {(r["__id"], r["text"]): r["__mark"] for r in rows.select("__id", "text", "__mark").limit(2 * sum(SAMPLE.values())).collect()}
    keys = sorted(found, key=lambda k: (zlib.crc32(str(k[0]).encode()), k))
    return [k[1] for k in keys], [int(found[k]) for k in keys]


def model_of(documents: DataFrame, labels: DataFrame) -> Network | Constant:
    return train(*sample(documents, labels))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: held_out, score, predicted (see DIGEST)."""
    shared = documents.sparkSession.sparkContext.broadcast(model_of(documents, labels))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.scores(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, DIGEST)


def cleaned(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with their own columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model_of(documents, labels))
    at = documents.columns.index("text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(b.column(at)) < threshold))

    return documents.mapInArrow(run, documents.schema)
