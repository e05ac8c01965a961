"""Benchmark decontamination by suffix arrays over shards of the training text.

Every slice of documents is a shard.  Its text is cut down to the stretches that
can match at all: names of 1, 2, 4 and 8 words are handed down from the
benchmark by doubling, and words in no named run are left out.  The suffixes of
what remains are sorted whole, every benchmark suffix that starts a window is
binary-searched among them, and the range of suffixes that agree with it in a
window gives all its places; a match that goes no further to the left is
lengthened to the right into the longest verbatim match.  Documents stay where
they are: no shuffle, one pass.

Defined results: null and empty texts have no words and are never contaminated;
repeated rows are judged alike, each for itself; an empty benchmark
hits nothing, an empty table of documents gives an empty result; texts of any length are searched whole;
windows that tie count for all items that have them; benchmark rows without id or words are left out, several rows with one id are
one item; other columns of the documents are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm import _tokens as tk

#: Benchmark text held by a task at once; a larger benchmark is gone through in blocks.
BLOCK_BYTES = 16 << 20
WINDOW = 13

DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MATCHES = "doc_id long, doc_word long, item_id string, item_word long, n_words long"


def half(n: int) -> int:
    """The greatest power of two up to n: two such runs make up n words."""
    return 1 << (n.bit_length() - 1)


class Names:
    """The benchmark's words and runs of 2, 4 and 8 words, each with its rank among its kind."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.ids = [k for k, _ in items]
        data, offs = tk.buffers(pa.array([t for _, t in items], pa.string()))
        data = tk.lower(data)
        start, end, self.offs = tk.words(data, offs, tk.table("alnum"))
        hashes = tk.Hashes(data).spans(start, end) if len(data) else np.empty(0, np.uint64)
        self.levels: dict[int, np.ndarray] = {1: np.unique(hashes)}
        self.doc = tk.owner(self.offs)
        self.ranks = {1: tk.in_sorted(hashes, self.levels[1])}
        size = 1
        while 2 * size <= window:
            keys = self._pair(self.ranks[size], size, size, self.offs)
            self.levels[2 * size] = np.unique(keys[keys >= 0])
            self.ranks[2 * size] = self._find(keys, self.levels[2 * size])
            size *= 2
        lengths = np.minimum(np.diff(self.offs), window)
        #: For each length of window: its suffixes by their windows, where each window's begin, and
        #: which names of half a window or more its items hold.
        self.search: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(lengths[lengths > 0]).tolist():
            keys = self.keys(self.ranks, self.offs, n)
            mine = lengths[self.doc] == n
            at = np.flatnonzero((keys >= 0) & mine)
            order = at[np.argsort(keys[at], kind="stable")]
            first = np.unique(keys[order], return_index=True)[1]
            size = half(n)
            held = np.zeros(len(self.levels[size]), bool)
            held[self.ranks[size][mine & (self.ranks[size] >= 0)]] = True
            self.search[n] = order, np.append(first, len(order)), held
        self.longest = int(np.diff(self.offs).max(initial=0))

    @staticmethod
    def _pair(ranks: np.ndarray, gap: int, size: int, offs: np.ndarray) -> np.ndarray:
        """Keys of a run of `size` names and the run `gap` words on, in the same document; else -1."""
        out = np.full(len(ranks), -1, np.int64)
        if len(ranks) > gap:
            a, b = ranks[: len(ranks) - gap], ranks[gap:]
            out[: len(a)] = np.where((a >= 0) & (b >= 0), (a << 31) | b, -1)
            doc_end = np.repeat(offs[1:], np.diff(offs))
            out[np.arange(len(ranks)) + gap + size > doc_end] = -1
        return out

    @staticmethod
    def _find(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        have = np.flatnonzero(keys >= 0)
        if len(known) and len(have):
            at = np.minimum(np.searchsorted(known, keys[have]), len(known) - 1)
            hit = known[at] == keys[have]
            out[have[hit]] = at[hit]
        return out

    def keys(self, ranks: dict[int, np.ndarray], offs: np.ndarray, n: int) -> np.ndarray:
        """For each position the key of its first n words: two overlapping runs of names."""
        return self._pair(ranks[half(n)], n - half(n), half(n), offs)

    def rank_words(self, hashes: np.ndarray, offs: np.ndarray) -> dict[int, np.ndarray]:
        """The names of the runs that start at each word of a shard; -1: not in the benchmark."""
        ranks = {1: tk.in_sorted(hashes, self.levels[1])}
        size = 1
        while 2 * size <= self.window:
            ranks[2 * size] = self._find(self._pair(ranks[size], size, size, offs), self.levels[2 * size])
            size *= 2
        return ranks


def suffix_array(words: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the words from each to its stretch's end, by doubling.

    Words past `depth` need not be told apart; equal suffixes stand in the order of position.
    """
    rank = np.unique(words, return_inverse=True)[1] + 1
    size, classes = 1, int(rank.max(initial=0))
    while size < depth and classes < len(words):
        then = np.arange(len(words)) + size
        after = np.where(then < ends, rank[np.minimum(then, len(words) - 1)], 0)
        rank = np.unique(rank * (len(words) + 1) + after, return_inverse=True)[1] + 1
        if (now := int(rank.max())) == classes:  # nothing told apart now is told apart later
            break
        size, classes = 2 * size, now
    return np.argsort(rank, kind="stable")


def bound(words: np.ndarray, ends: np.ndarray, suffixes: np.ndarray, bench: np.ndarray, tests: np.ndarray, n: int, after: bool) -> np.ndarray:
    """For each test suffix by binary search the first suffix not below (after: above) its first n words."""
    low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(suffixes), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        at, test, sign = suffixes[middle], tests[open_], np.zeros(len(open_), np.int64)
        equal = np.arange(len(open_))
        for k in range(n):
            here = at[equal] + k
            word = np.where(here < ends[at[equal]], words[np.minimum(here, len(words) - 1)], -1)
            sign[equal] = np.sign(word - bench[test[equal] + k])
            equal = equal[sign[equal] == 0]
        below = sign <= 0 if after else sign < 0
        low[open_[below]], high[open_[~below]] = middle[below] + 1, middle[~below]
    return low


def shard_hits(names: Names, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, int]]]:
    """One shard: offsets of its words; their names; and for each window that occurs, the words at
    which it does, the benchmark words at which it stands, and its length."""
    data = tk.lower(data)
    start, end, word_offs = tk.words(data, offs, tk.table("alnum"))
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    if not len(start) or not names.search:
        return word_offs, np.full(len(start), -1, np.int64), found
    ranks = names.rank_words(tk.Hashes(data).spans(start, end), word_offs)
    opened, seen = np.zeros(len(start) + 1, np.int64), {}
    for n, (_, _, held) in names.search.items():
        at = np.flatnonzero(ranks[half(n)] >= 0)
        at = at[held[ranks[half(n)][at]]]
        opened[at] += 1
        opened[at + half(n)] -= 1
        seen[n] = np.zeros(len(held), bool)
        seen[n][ranks[half(n)][at]] = True
    place = np.flatnonzero(np.cumsum(opened[:-1]) > 0)  # the words that can match
    if len(place):
        first_word = np.zeros(len(start) + 1, bool)
        first_word[word_offs[:-1]] = True
        new = first_word[place]
        new[0] = True
        new[1:] |= np.diff(place) > 1
        first = np.flatnonzero(new)
        lengths = np.diff(np.append(first, len(place)))
        ends = np.repeat(first + lengths, lengths)
        words, bench = ranks[1][place], names.ranks[1]
        suffixes = suffix_array(words, ends, min(int(lengths.max()), names.longest))
        for n, (order, group, _) in names.search.items():
            have = np.flatnonzero(seen[n][names.ranks[half(n)][order[group[:-1]]]])
            tests = order[group[have]]
            lo = bound(words, ends, suffixes, bench, tests, n, False)
            hi = bound(words, ends, suffixes, bench, tests, n, True)
            found += [(place[suffixes[lo[t] : hi[t]]], order[group[have[t]] : group[have[t] + 1]], n) for t in np.flatnonzero(hi > lo)]
    return word_offs, ranks[1], found


def longest(names: Names, words: np.ndarray, word_offs: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The matches that can be lengthened to neither side: word, benchmark word, length."""
    bench, begin, stop = names.ranks[1], names.offs[:-1], names.offs[1:]
    for at, test, n in found:
        doc = np.searchsorted(word_offs, at, "right") - 1
        left = np.where(at > word_offs[doc], words[at - 1], -1)
        before = np.where(test > begin[names.doc[test]], bench[test - 1], -2)
        for word in np.unique(before).tolist():
            free, tests = left != word, test[before == word]
            for t in tests.tolist():
                a, last = at[free], word_offs[doc[free] + 1]
                length, more = np.full(len(a), n), np.arange(len(a))
                for k in range(n, int(stop[names.doc[t]]) - t):
                    more = more[a[more] + k < last[more]]
                    more = more[words[a[more] + k] == bench[t + k]]
                    if not len(more):
                        break
                    length[more] += 1
                if len(a):
                    yield a, np.full(len(a), t), length


def judge(texts: pa.Array, blocks: list[Names]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """For each text its words, its hit words and the items whose windows occur."""
    data, offs = tk.buffers(texts)
    n_words, n_hit, items = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [set() for _ in range(len(texts))]
    for first, last, part, part_offs in tk.slices(data, offs):
        opened = None
        for names in blocks:
            word_offs, _, found = shard_hits(names, part, part_offs)
            if opened is None:
                opened = np.zeros(word_offs[-1] + 1, np.int64)
                n_words[first:last] = np.diff(word_offs)
            for at, test, n in found:
                opened[at] += 1  # a window starts at a word once
                opened[at + n] -= 1
                ids = {names.ids[i] for i in np.unique(names.doc[test]).tolist()}
                for d in np.unique(np.searchsorted(word_offs, at, "right") - 1).tolist():
                    items[first + d] |= ids
        if opened is not None:
            covered = np.append(0, np.cumsum(np.cumsum(opened)[:-1] > 0))
            n_hit[first:last] = covered[word_offs[1:]] - covered[word_offs[:-1]]
    return n_words, n_hit, items


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of bounded size, as they come from one partition after another."""
    rows, size = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _load(benchmark: DataFrame, window: int) -> list[list[tuple[str, str]]]:
    """All blocks, if they are few; a benchmark beyond that isn't one."""
    out = []
    for block in blocks_of(benchmark, window):
        out.append(block)
        if len(out) > 8:
            raise ValueError(f"the benchmark is larger than 8 blocks of {BLOCK_BYTES} bytes; go through it in parts")
    return out or [[]]


def _indexed(shared, window: int) -> list[Names]:
    return [Names(block, window) for block in shared.value]


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (see DIGEST)."""
    shared = documents.sparkSession.sparkContext.broadcast(_load(benchmark, window))

    def run(batches):
        blocks = _indexed(shared, window)
        for b in batches:
            n_words, n_hit, items = judge(b.column(1), blocks)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()), pa.array((n_hit > 0) & (20 * n_hit >= n_words))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGEST)


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The longest verbatim matches of at least a window, with their places (see MATCHES)."""
    shared = documents.sparkSession.sparkContext.broadcast(_load(benchmark, window))

    def run(batches):
        blocks = _indexed(shared, window)
        for b in batches:
            ids = b.column(0)
            data, offs = tk.buffers(b.column(1))
            for first, _, part, part_offs in tk.slices(data, offs):
                for names in blocks:
                    word_offs, words, found = shard_hits(names, part, part_offs)
                    for at, test, n in longest(names, words, word_offs, found):
                        doc, item = np.searchsorted(word_offs, at, "right") - 1, names.doc[test]
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(first + doc, pa.int64())), pa.array(at - word_offs[doc], pa.int64()), pa.array([names.ids[i] for i in item.tolist()], pa.string()), pa.array(test - names.offs[item], pa.int64()), pa.array(n, pa.int64())],
                            names=["doc_id", "doc_word", "item_id", "item_word", "n_words"],
                        )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MATCHES)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(_load(benchmark, window))
    at = documents.columns.index("text")

    def run(batches):
        blocks = _indexed(shared, window)
        for b in batches:
            n_words, n_hit, _ = judge(b.column(at), blocks)
            yield b.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words))))

    return documents.mapInArrow(run, documents.schema)
