"""The part of CBOR (RFC 8949) that log records and messages use: integers, byte and text strings,
arrays, maps, booleans, null.  Encoding is canonical in lengths; decoding is strict."""

from __future__ import annotations

import struct


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for extra, size, form in ((24, 1, ">B"), (25, 2, ">H"), (26, 4, ">I"), (27, 8, ">Q")):
        if n < 1 << 8 * size:
            return bytes([major << 5 | extra]) + struct.pack(form, n)
    raise ValueError("number too large")


def encode(x) -> bytes:
    if x is None:
        return b"\xf6"
    if x is True or x is False:
        return b"\xf5" if x else b"\xf4"
    if isinstance(x, int):
        return _head(0, x) if x >= 0 else _head(1, -1 - x)
    if isinstance(x, (bytes, bytearray, memoryview)):
        return _head(2, len(x)) + bytes(x)
    if isinstance(x, str):
        raw = x.encode()
        return _head(3, len(raw)) + raw
    if isinstance(x, (list, tuple)):
        return _head(4, len(x)) + b"".join(map(encode, x))
    if isinstance(x, dict):
        return _head(5, len(x)) + b"".join(encode(k) + encode(v) for k, v in x.items())
    raise TypeError(f"{type(x).__name__} has no CBOR form here")


def _item(data: bytes, at: int):
    if at >= len(data):
        raise ValueError("CBOR ends early")
    major, n = data[at] >> 5, data[at] & 31
    at += 1
    if major == 7:
        if n in (20, 21, 22):
            return (False, True, None)[n - 20], at
        raise ValueError("unknown simple value")
    if n >= 24:
        size = {24: 1, 25: 2, 26: 4, 27: 8}.get(n)
        if size is None or at + size > len(data):
            raise ValueError("bad length")
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if at + n > len(data):
            raise ValueError("string ends early")
        raw = bytes(data[at : at + n])
        return raw if major == 2 else raw.decode(), at + n
    if major == 4:
        out = []
        for _ in range(n):
            x, at = _item(data, at)
            out.append(x)
        return out, at
    if major == 5:
        pairs = {}
        for _ in range(n):
            k, at = _item(data, at)
            pairs[k], at = _item(data, at)
        return pairs, at
    raise ValueError("tags aren't used")


def decode(data: bytes):
    """One item that takes up all of data."""
    x, at = _item(data, 0)
    if at != len(data):
        raise ValueError("bytes after the item")
    return x


#: Numbers of the operations of a record.
SET, DEL = 1, 2


def encode_record(revision: int, phys_ms: int, logical: int, node_id: str, op: str, key: bytes, value: bytes | None) -> bytes:
    """A change record: seven fields in order."""
    return encode([revision, phys_ms, logical, node_id, SET if op == "SET" else DEL, key, value])


def decode_record(data: bytes | list) -> tuple:
    """(revision, phys_ms, logical, node_id, op, key, value)."""
    x = decode(data) if isinstance(data, (bytes, bytearray)) else data
    if len(x) != 7 or x[4] not in (SET, DEL):
        raise ValueError("not a change record")
    return (*x[:4], "SET" if x[4] == SET else "DEL", x[5], x[6])


def encode_timestamp(phys_ms: int, logical: int, node_id: str) -> bytes:
    return encode([phys_ms, logical, node_id])


def decode_timestamp(data: bytes) -> tuple[int, int, str]:
    x = decode(data)
    if len(x) != 3:
        raise ValueError("not a timestamp")
    return tuple(x)
