"""Vectorised tokenising and hashing of whole text columns.

A column of texts is one byte buffer with offsets.  Word boundaries, word
hashes and substring hashes are found for the whole buffer with array
operations; nothing here loops over characters.  Buffers are cut into slices
of whole documents so that the working arrays stay small whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document makes a slice of its own.
SLICE_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that any bits of the result may be used."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    have = _tables.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _MULT), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[name] = np.cumprod(table, dtype=np.uint64)
    return _tables["up"], _tables["down"]


class Hashes:
    """Polynomial hashes of any span of a buffer from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * up[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of data[start:end]; equal bytes have equal hashes."""
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def grams(self, width: int) -> np.ndarray:
        """Mixed hashes of all spans of one width, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and each text's offset; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about `limit` bytes: first, last + 1, bytes, offsets."""
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def table(pattern_of: str) -> np.ndarray:
    """Which bytes belong to words.  "alnum": 0-9, a-z and all of non-ASCII; "blank": all but
    space and control 9 to 13."""
    out = np.zeros(256, bool)
    if pattern_of == "alnum":
        out[ord("0") : ord("9") + 1] = out[ord("a") : ord("z") + 1] = True
        out[128:] = True
    else:
        out[:] = True
        out[[32, *range(9, 14)]] = False
    return out


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    case = np.arange(256, dtype=np.uint8)
    case[65:91] += 32
    return case[data]


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each document's offset into them."""
    inside = is_word[data]
    cuts = offs[(offs > 0) & (offs < len(data))]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[cuts], after[cuts - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def owner(offs: np.ndarray) -> np.ndarray:
    """For each element under offsets, the index of its document."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of n consecutive word hashes, by the first word."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[k : k + len(out)]
    return mix(out)


def in_sorted(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each value its index in sorted keys, or -1; most misses cost one look at a bitmap."""
    out = np.full(len(values), -1, np.int64)
    if not len(keys) or not len(values):
        return out
    seen = np.zeros(1 << 20, bool)
    seen[(keys >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(values >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, values[maybe]), len(keys) - 1)
    hit = keys[at] == values[maybe]
    out[maybe[hit]] = at[hit]
    return out
