"""Codecs over columns: batches go through Arrow, rows through the plain functions beside this."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideline.functions import cbor, messages
from tideline.functions.crc64 import crc64_column


def _head(major: int, n: Column) -> Column:
    """The head of an item: its kind, and a length or number in as few bytes as it takes."""
    wide = lambda extra, digits: F.concat(F.lit(bytearray([major << 5 | extra])), F.unhex(F.lpad(F.hex(n), digits, "0")))
    small = F.unhex(F.lpad(F.hex(n + (major << 5)), 2, "0"))
    return F.when(n < 24, small).when(n < 1 << 8, wide(24, 2)).when(n < 1 << 16, wide(25, 4)).when(n < 1 << 32, wide(26, 8)).otherwise(wide(27, 16))


def _number(c: str) -> Column:
    n = F.col(c).cast("long")
    return F.when(n >= 0, _head(0, n)).otherwise(_head(1, -1 - n))


def _string(major: int, c: str) -> Column:
    return F.concat(_head(major, F.octet_length(c).cast("long")), F.col(c).cast("binary"))


def timestamp(phys_ms: str, logical: str, node_id: str) -> Column:
    """A hybrid timestamp in CBOR: an array of its three fields."""
    return F.concat(F.lit(bytearray([0x83])), _number(phys_ms), _number(logical), _string(3, node_id))


def record() -> Column:
    """A change record in CBOR: an array of seven fields, of a log's columns."""
    value = F.coalesce(_string(2, "value"), F.lit(bytearray([0xF6])))
    op = F.when(F.col("op") == "SET", F.lit(bytearray([cbor.SET]))).otherwise(F.lit(bytearray([cbor.DEL])))
    return F.concat(F.lit(bytearray([0x87])), _number("revision"), _number("phys_ms"), _number("logical"), _string(3, "node_id"), op, _string(2, "key"), value)


def entry() -> Column:
    """A key's row in a snapshot in CBOR: an array of five fields, of a state's columns."""
    value = F.coalesce(_string(2, "value"), F.lit(bytearray([0xF6])))
    return F.concat(F.lit(bytearray([0x85])), _string(2, "key"), value, _number("phys_ms"), _number("logical"), _string(3, "node_id"))


def list_head(n: Column) -> Column:
    """The head of an array of n items in CBOR."""
    return _head(4, n)


def encoded(log: DataFrame) -> DataFrame:
    """seq, payload (CBOR), crc of the payload, record_bytes on disk."""
    return log.select("seq", record().alias("payload")).select("seq", "payload", crc64_column(F.col("payload")).alias("crc"), (F.octet_length("payload") + 20).alias("record_bytes"))


def decoded(rows: DataFrame) -> DataFrame:
    """Back from seq, payload to the log's columns."""

    def run(frames):
        for pdf in frames:
            out = [(int(s), *cbor.decode_record(bytes(p))) for s, p in zip(pdf["seq"], pdf["payload"], strict=True)]
            yield pd.DataFrame([(*r[:6], r[6].decode(), None if r[7] is None else r[7].decode()) for r in out], columns=["seq", "revision", "phys_ms", "logical", "node_id", "op", "key", "value"])

    return rows.select("seq", "payload").mapInPandas(run, "seq long, revision long, phys_ms long, logical int, node_id string, op string, key string, value string")


def decoded_timestamps(rows: DataFrame) -> DataFrame:
    """Back from seq, t to phys_ms, logical and node_id."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(s, *cbor.decode_timestamp(bytes(t))) for s, t in zip(pdf["seq"], pdf["t"], strict=True)], columns=["seq", "phys_ms", "logical", "node_id"])

    return rows.select("seq", "t").mapInPandas(run, "seq long, phys_ms long, logical int, node_id string")


@F.pandas_udf(T.BinaryType())
def framed(payload: pd.Series) -> pd.Series:
    return payload.map(lambda b: messages.frame(bytes(b)))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def unframed(data: pd.Series) -> pd.Series:
    return data.map(lambda b: list(messages.frames(bytes(b))))


@F.pandas_udf(T.BinaryType())
def packed_keys(keys: pd.Series) -> pd.Series:
    return keys.map(lambda ks: messages.pack_keys([k if isinstance(k, bytes) else k.encode() for k in ks]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def unpacked_keys(data: pd.Series) -> pd.Series:
    return data.map(lambda b: [k.decode() for k in messages.unpack_keys(bytes(b))])
