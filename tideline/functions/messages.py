"""Replication messages as CBOR arrays that begin with their type, and length-prefixed frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from tideline.functions import cbor

#: Each message's type number and fields in order.
MESSAGES = {
    "hello": (0, ("cluster_id", "node_id", "region_id", "protocol", "options")),
    "hello_ack": (1, ("protocol", "node_id", "last_revision", "info")),
    "follow": (2, ("from_revision", "stream_id", "options")),
    "follow_accept": (3, ("stream_id", "effective_from", "require_snapshot")),
    "snapshot_start": (4, ("stream_id", "snapshot_id", "last_revision", "total_bytes", "chunk_bytes")),
    "snapshot_chunk": (5, ("stream_id", "snapshot_id", "chunk_index", "data")),
    "snapshot_end": (6, ("stream_id", "snapshot_id")),
    "wal_batch": (7, ("stream_id", "base_revision", "last_revision", "records")),
    "heartbeat": (8, ("stream_id", "last_revision")),
    "ack": (9, ("stream_id", "applied", "max_in_flight")),
    "error": (10, ("stream_id", "code", "message")),
}
#: Error codes in order from 0.
ERRORS = ("unknown", "protocol_mismatch", "cluster_id_mismatch", "unsupported_version", "invalid_follow", "snapshot_failed", "wal_gap_too_large", "internal_error")
NAMES = {number: name for name, (number, _) in MESSAGES.items()}


def encode(name: str, **fields) -> bytes:
    number, names = MESSAGES[name]
    if fields.keys() != set(names):
        raise ValueError(f"{name} has the fields {', '.join(names)}")
    if "options" in fields:
        fields["options"] = fields["options"] or {}
    if name == "wal_batch":
        fields["records"] = [cbor.decode(cbor.encode_record(*r)) for r in fields["records"]]
    return cbor.encode([number, *(fields[n] for n in names)])


def peek(data: bytes) -> str:
    """Which message this is."""
    x = cbor.decode(data)
    if not isinstance(x, list) or not x or x[0] not in NAMES:
        raise ValueError("not a message")
    return NAMES[x[0]]


def decode(data: bytes, expected: str | None = None) -> tuple[str, dict]:
    """A message's name and fields; an unexpected type or count of fields is an error."""
    name = peek(data)
    if expected is not None and name != expected:
        raise ValueError(f"{name} came in place of {expected}")
    x = cbor.decode(data)
    names = MESSAGES[name][1]
    if len(x) != len(names) + 1:
        raise ValueError(f"{name} has {len(names) + 1} items, not {len(x)}")
    fields = dict(zip(names, x[1:], strict=True))
    if name == "wal_batch":
        fields["records"] = [cbor.decode_record(r) for r in fields["records"]]
    return name, fields


def frame(payload: bytes) -> bytes:
    """A payload behind its length, four bytes with the highest first."""
    if not payload:
        raise ValueError("an empty frame isn't valid")
    return struct.pack(">i", len(payload)) + payload


def frames(data: bytes) -> Iterator[bytes]:
    """The payloads of frames one after another; an end within a frame is an error."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise EOFError("data ends within a length")
        (n,) = struct.unpack_from(">i", data, at)
        if n <= 0:
            raise ValueError("a frame's length must be positive")
        if at + 4 + n > len(data):
            raise EOFError("data ends within a frame")
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


def pack_keys(keys: list[bytes]) -> bytes:
    """Keys behind their count and offsets (from the start), four bytes each with the lowest first."""
    at, offsets = 4 + 4 * len(keys), []
    for k in keys:
        offsets.append(at)
        at += len(k)
    return struct.pack(f"<{len(keys) + 1}i", len(keys), *offsets) + b"".join(keys)


def packed_count(data: bytes) -> int:
    return struct.unpack_from("<i", data)[0]


def packed_key(data: bytes, index: int) -> bytes:
    n = packed_count(data)
    if not 0 <= index < n:
        raise IndexError(index)
    (start,) = struct.unpack_from("<i", data, 4 + 4 * index)
    end = len(data) if index + 1 == n else struct.unpack_from("<i", data, 8 + 4 * index)[0]
    return data[start:end]


def unpack_keys(data: bytes) -> list[bytes]:
    return [packed_key(data, i) for i in range(packed_count(data))]
