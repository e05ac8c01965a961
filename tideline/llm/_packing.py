"""Columns of numbers as small blobs, many of them to a row, and rows by key."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np


def packed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, deflated: high bytes cost next to nothing."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unpacked(blobs: list[bytes], kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel() for b in blobs]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def steps(ids: np.ndarray) -> bytes:
    return packed(np.diff(ids, prepend=np.int64(0)))


def ids_of(blobs: list[bytes]) -> np.ndarray:
    parts = [np.cumsum(unpacked([b], np.int64)) for b in blobs]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def short(x: np.ndarray, size: int) -> bytes:
    """The highest bytes of 64-bit numbers, which keep their order."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def long(blob: bytes, size: int) -> np.ndarray:
    """What short() made, with zeros for the bytes that it left out."""
    out = np.zeros((len(blob) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(blob, np.uint8).reshape(-1, size)
    return out.view(">u8").ravel().astype(np.uint64)


def groups_of(batches) -> Iterator[list[tuple]]:
    """Rows that come sorted by their first column, a list for each of its values."""
    rows: list[tuple] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and r[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows
