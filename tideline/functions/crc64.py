"""CRC-64 as ECMA-182 defines it, of byte strings and of columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Fixed value: the generator polynomial; most significant bit first, no inversion.
POLYNOMIAL = 0x42F0E1EBA9EA3693
MASK = (1 << 64) - 1


def _table() -> list[int]:
    out = []
    for byte in range(256):
        x = byte << 56
        for _ in range(8):
            x = (x << 1 ^ POLYNOMIAL if x >> 63 else x << 1) & MASK
        out.append(x)
    return out


TABLE = _table()


def crc64(data: bytes, x: int = 0) -> int:
    """The checksum of data, or of what gave x with data after it."""
    for b in data:
        x = (x << 8 & MASK) ^ TABLE[x >> 56 ^ b]
    return x


#: Fewer values than this are finished one by one.
FEW = 16
_COLUMN = np.array(TABLE, np.uint64)


def crc64_many(values: Sequence[bytes]) -> np.ndarray:
    """The checksums of many values: a byte of each at a time, longest values first."""
    size = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(values), np.uint8)
    start = (np.cumsum(size) - size)[order]
    left, x = size[order], np.zeros(len(values), np.uint64)
    at = 0
    while (n := int(np.searchsorted(-left, -at, "left"))) >= FEW:
        until = int(left[n - 1])  # all of the first n are at least this long
        for k in range(at, until):
            x[:n] = (x[:n] << np.uint64(8)) ^ _COLUMN[(x[:n] >> np.uint64(56)) ^ data[start[:n] + k]]
        at = until
    for i in range(n):
        x[i] = crc64(values[order[i]][at:], int(x[i]))
    out = np.empty_like(x)
    out[order] = x
    return out


@F.pandas_udf(T.LongType())
def _crc64_column(data: pd.Series) -> pd.Series:
    out = pd.Series(pd.NA, index=data.index, dtype="Int64")
    has = data.notna()
    out[has] = crc64_many([bytes(b) for b in data[has]]).view(np.int64)
    return out


def crc64_column(c: Column) -> Column:
    """The checksum of binary values as a signed 64-bit number."""
    return _crc64_column(c)
