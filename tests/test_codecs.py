"""Codecs there and back, and the binary log with damage at every byte."""

import os

import pytest
from hypothesis import given, settings, strategies as st

from tideline.functions import cbor, messages
from tideline.functions.crc64 import crc64, crc64_many
from tideline.sources import wal

LEAF = st.none() | st.booleans() | st.integers(-(2**64), 2**64 - 1) | st.binary(max_size=30) | st.text(max_size=30)
TREE = st.recursive(LEAF, lambda x: st.lists(x, max_size=5) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(TREE)
def test_cbor(x):
    assert cbor.decode(cbor.encode(x)) == x


def test_cbor_bytes():
    assert cbor.encode([1, -1, 500, b"a", "é", None, True, {}]).hex() == "8801201901f4416162c3a9f6f5a0"
    for bad in (b"", b"\x18", b"\x41", b"\x81", b"\xff", b"\x00\x00", b"\xc0\x00"):
        with pytest.raises(ValueError):
            cbor.decode(bad)


def test_records_and_timestamps():
    r = (5, 10, 2, "n", "DEL", b"k\xff", None)
    assert cbor.decode_record(cbor.encode_record(*r)) == r
    assert cbor.decode_timestamp(cbor.encode_timestamp(1, 2, "n")) == (1, 2, "n")
    with pytest.raises(ValueError):
        cbor.decode_record(cbor.encode([1, 2, 3]))


SAMPLES = {
    "hello": {"cluster_id": "c", "node_id": "n", "region_id": "r", "protocol": 1, "options": {"a": "b"}},
    "hello_ack": {"protocol": 1, "node_id": "n", "last_revision": 9, "info": None},
    "follow": {"from_revision": 3, "stream_id": "s", "options": {}},
    "follow_accept": {"stream_id": "s", "effective_from": 4, "require_snapshot": True},
    "snapshot_start": {"stream_id": "s", "snapshot_id": 1, "last_revision": 2, "total_bytes": 3, "chunk_bytes": 4},
    "snapshot_chunk": {"stream_id": "s", "snapshot_id": 1, "chunk_index": 0, "data": b"\x00\x01"},
    "snapshot_end": {"stream_id": "s", "snapshot_id": 1},
    "wal_batch": {"stream_id": "s", "base_revision": 1, "last_revision": 2, "records": [(2, 3, 0, "n", "SET", b"k", b"v")]},
    "heartbeat": {"stream_id": "s", "last_revision": 1},
    "ack": {"stream_id": "s", "applied": 1, "max_in_flight": 2},
    "error": {"stream_id": "s", "code": 6, "message": "gap"},
}


@pytest.mark.parametrize("name", list(messages.MESSAGES))
def test_messages(name):
    data = messages.encode(name, **SAMPLES[name])
    assert messages.peek(data) == name and messages.decode(data, name) == (name, SAMPLES[name])
    with pytest.raises(ValueError):
        messages.decode(data, "ack" if name != "ack" else "error")
    with pytest.raises(ValueError):
        messages.decode(cbor.encode([*cbor.decode(data), 0]))


def test_frames():
    body = [cbor.encode(x) for x in (100, 200, 300)]
    data = b"".join(map(messages.frame, body))
    assert list(messages.frames(data)) == body and list(messages.frames(b"")) == []
    assert data[:4] == b"\0\0\0\2"
    for n in range(1, len(data)):
        ends = {0, 6, 12, 19}
        if n not in {0, 6, 6 + 6, len(data)} and n not in ends:
            with pytest.raises(EOFError):
                list(messages.frames(data[:n]))
    with pytest.raises(ValueError):
        list(messages.frames(b"\0\0\0\0"))


@given(st.lists(st.binary(max_size=10), max_size=8))
def test_packed_keys(keys):
    data = messages.pack_keys(keys)
    assert messages.packed_count(data) == len(keys) and messages.unpack_keys(data) == keys
    with pytest.raises(IndexError):
        messages.packed_key(data, len(keys))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=60))
def test_checksums_together(values):
    assert crc64_many(values).tolist() == [crc64(v) for v in values]


def test_recovery_at_every_byte(tmp_path):
    whole = b"".join(wal.pack(i, bytes([i]) * i) for i in range(1, 6))
    ends = [e for _, _, e in wal.records(whole)]
    path = str(tmp_path / "x.log")
    for cut in range(len(whole) + 1):
        with open(path, "wb") as f:
            f.write(whole[:cut])
        n = sum(e <= cut for e in ends)
        assert wal.recovered(path) == (1 if n else 0, n, cut - ([0, *ends][n]))
        assert os.path.getsize(path) == [0, *ends][n]
    for at in range(len(whole)):
        data = bytearray(whole)
        data[at] ^= 255
        got = [(s, p) for s, p, _ in wal.records(bytes(data))]
        n = sum(e <= at for e in ends)
        assert len(got) >= n and got[:n] == [(i, bytes([i]) * i) for i in range(1, n + 1)]
    assert crc64(b"") == 0


def test_source(spark, tmp_path):
    spark.dataSource.register(wal.WalSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = str(tmp_path / "wal")
    rows = [(i, bytes([i % 256]) * (i % 40)) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "seq long, payload binary").repartitionByRange(3, "seq").sortWithinPartitions("seq")
    df.write.format("wal").option("path", path).option("segment_bytes", 512).mode("append").save()
    read = lambda: spark.read.format("wal").option("path", path).load()
    assert sorted((r[0], bytes(r[1])) for r in read().collect()) == rows
    after = read().where("seq > 150")
    assert sorted(r[0] for r in after.collect()) == list(range(151, 201))
    assert after.rdd.getNumPartitions() < read().rdd.getNumPartitions()
    assert wal.collect_segments(path, 100) > 0 and read().where("seq > 100").count() == 100
    name = sorted(x for x in os.listdir(path) if x.endswith(".log"))[-1]
    with open(os.path.join(path, name), "r+b") as f:
        data = f.read()
        f.seek(len(data) - 1)
        f.write(bytes([data[-1] ^ 255]))
    assert read().where("seq > 100").count() == 99
    with pytest.raises(Exception, match="bad record"):
        spark.read.format("wal").option("path", path).option("recover", "fail").load().count()


def test_records_made_by_columns(spark):
    """CBOR by column expressions is that of the plain functions, at every size of a head."""
    from tideline.functions import codec

    numbers = [0, 23, 24, 255, 256, 65535, 65536, (1 << 32) - 1, 1 << 32, (1 << 62) + 5, -1, -24, -25, -300, -(1 << 40)]
    texts = ["", "k", "é" * 11, "x" * 12, "x" * 23, "x" * 24, "y" * 255, "y" * 256, "z" * 70000]
    rows = [(i, n, n, i, texts[i % 9], "SET" if i % 3 else "DEL", texts[(i + 1) % 9], texts[(i + 2) % 9] if i % 3 else None) for i, n in enumerate(numbers)]
    df = spark.createDataFrame(rows, "seq long, revision long, phys_ms long, logical int, node_id string, op string, key string, value string")
    got = {r["seq"]: r for r in codec.encoded(df).collect()}
    for seq, rev, phys, logical, node, op, key, value in rows:
        assert bytes(got[seq]["payload"]) == cbor.encode_record(rev, phys, logical, node, op, key.encode(), None if value is None else value.encode())
    stamps = df.select("seq", codec.timestamp("phys_ms", "logical", "node_id").alias("t")).collect()
    assert all(cbor.decode_timestamp(bytes(r["t"])) == rows[r["seq"]][2:5] for r in stamps)
