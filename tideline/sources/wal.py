"""A source and sink for binary logs.

A folder holds segments, each a file of records: seq (8 bytes, lowest first), length (4, lowest
first), payload, CRC-64 of the payload (8, lowest first).  Files are named by their bounds,
rows, job, writer and number with that writer, and no file says more than its own records do; a scan after
a seq skips files that end before it, by a manifest of bounds that the sink keeps.

Options: path (required), segment_bytes, recover (truncate: a bad record ends its
file, as what comes after can't be trusted; fail: it is an error).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, WriterCommitMessage

from tideline.functions.crc64 import crc64, crc64_many
from tideline.operators.segments import OVERHEAD, RECORD_BYTES, SEGMENT_BYTES


def pack(seq: int, payload: bytes) -> bytes:
    if len(payload) > RECORD_BYTES:
        raise ValueError("a record is too large")
    return struct.pack("<qi", seq, len(payload)) + payload + struct.pack("<Q", crc64(payload))


#: Records whose checksums are made together.
CHECKED = 1024


def records(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(seq, payload, end) of the sound records from the start; stops at the first that isn't."""
    at, whole = 0, True
    while whole:
        held: list[tuple[int, bytes, int, int]] = []
        while len(held) < CHECKED:
            whole = at + 12 <= len(data)
            seq, n = struct.unpack_from("<qi", data, at) if whole else (0, 0)
            whole = whole and seq > 0 and 0 <= n <= RECORD_BYTES and at + OVERHEAD + n <= len(data)
            if not whole:
                break
            said = struct.unpack_from("<Q", data, at + 12 + n)[0]
            at += OVERHEAD + n
            held.append((seq, data[at - 8 - n : at - 8], at, said))
        for (seq, payload, end, said), crc in zip(held, crc64_many([h[1] for h in held]).tolist(), strict=True):
            if said != crc:
                return
            yield seq, payload, end


def recovered(path: str) -> tuple[int, int, int]:
    """Cuts a file behind its last sound record; its first and last seq (0 if none), bytes cut off."""
    with open(path, "rb") as f:
        data = f.read()
    first = last = end = 0
    for seq, _, end in records(data):
        first, last = first or seq, seq
    if end < len(data):
        with open(path, "r+b") as f:
            f.truncate(end)
    return first, last, len(data) - end


OPENED = "segment string, first_seq long, last_seq long, cut_bytes long"


def opened(spark: SparkSession, path: str) -> DataFrame:
    """Goes through all segments of a folder, cuts each behind its last sound record, and says what it
    holds: segment, first_seq, last_seq, cut_bytes.  Writing goes on behind the greatest last_seq."""
    path = local(path)

    def run(frames):
        for pdf in frames:
            out = [(name, *recovered(os.path.join(path, name))) for name in pdf["segment"]]
            yield pd.DataFrame(out, columns=["segment", "first_seq", "last_seq", "cut_bytes"])

    names = [(x,) for x in sorted(os.listdir(path)) if x.endswith(".log")]
    return spark.createDataFrame(names, "segment string").repartition(max(1, min(len(names), 1000))).mapInPandas(run, OPENED)


def files(path: str) -> list[str]:
    """The segments of a folder, in order."""
    path = local(path)
    return [os.path.join(path, x) for x in sorted(os.listdir(path)) if x.endswith(".log")]


def last_files(path: str) -> list[str]:
    """Of each writer the segment that it wrote last: all others were closed, so a crash tears only these."""
    last: dict[tuple[str, ...], tuple[int, str]] = {}
    for name in files(path):
        *writer, i = os.path.basename(name).split(".")[0].split("-")[3:]
        last[tuple(writer)] = max(last.get(tuple(writer), (-1, "")), (int(i), name))
    return sorted(name for _, name in last.values())


def local(path: str) -> str:
    """The folder as this machine sees it; it has to be mounted everywhere."""
    return path.removeprefix("file:").replace("//", "/") if path.startswith("file:") else path


class Segment(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.recover, self.after = local(options["path"]), options.get("recover", "truncate"), 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)) and f.attribute == ("seq",):
                self.after = max(self.after, f.value - (not isinstance(f, GreaterThan)))
            yield f  # Spark checks each row again

    def partitions(self) -> list[Segment]:
        found = []
        for name in sorted(os.listdir(self.path)):
            if name.endswith(".log"):
                bounds = name.split(".")[0].split("-")
                if len(bounds) < 2 or int(bounds[1]) > self.after:
                    found.append(Segment(os.path.join(self.path, name)))
        return found

    def read(self, partition: Segment) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        end = 0
        for seq, payload, end in records(data):
            if seq > self.after:
                yield seq, payload
        if end < len(data) and self.recover == "fail":
            raise ValueError(f"{partition.path} has a bad record at byte {end}")


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int, int, int, int]]):
        self.files = files


class WalWriter(DataSourceWriter):
    """Segments appear when all tasks have ended: files are renamed on commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.cap, self.overwrite = local(options["path"]), int(options.get("segment_bytes", SEGMENT_BYTES)), overwrite
        self.job = uuid.uuid4().hex

    def write(self, rows) -> Written:
        os.makedirs(self.path, exist_ok=True)
        files: list[tuple[str, int, int, int, int]] = []
        f, first, last, n, size = None, 0, 0, 0, 0

        def close():
            if f:
                f.flush()
                os.fsync(f.fileno())
                f.close()
                files.append((f.name, first, last, n, size))

        for row in rows:
            body = pack(row["seq"], bytes(row["payload"]))
            if f is None or n and size + len(body) > self.cap:
                close()
                f, first, n, size = open(os.path.join(self.path, f".{self.job}-{uuid.uuid4().hex}.tmp"), "wb"), row["seq"], 0, 0  # noqa: SIM115
            f.write(body)
            last, n, size = row["seq"], n + 1, size + len(body)
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        old = [x for x in os.listdir(self.path) if x.endswith(".log")] if self.overwrite else []
        for writer, m in enumerate(messages):
            for i, (name, first, last, n, _) in enumerate(m.files if m else ()):
                os.replace(name, os.path.join(self.path, f"{first:020d}-{last:020d}-{n}-{self.job[:8]}-{writer}-{i}.log"))
        for name in old:
            os.remove(os.path.join(self.path, name))
        self._clear()
        names = sorted(x for x in os.listdir(self.path) if x.endswith(".log"))
        body = {"CurrentSegmentId": len(names), "LastSeq": max((int(x.split("-")[1]) for x in names), default=0), "SegmentSizeBytes": self.cap}
        with open(os.path.join(self.path, "manifest.json"), "w") as f:
            json.dump(body, f)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Removes what tasks of this job left that didn't end."""
        for name in os.listdir(self.path) if os.path.isdir(self.path) else ():
            if name.startswith(f".{self.job}-"):
                os.remove(os.path.join(self.path, name))


class WalSource(DataSource):
    """The format "wal", once it is registered."""

    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self) -> str:
        return "seq long, payload binary"

    def reader(self, schema) -> WalReader:
        return WalReader(self.options)

    def writer(self, schema, overwrite: bool) -> WalWriter:
        return WalWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters on seq reach its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WalSource)


def collect_segments(path: str, least_seq: int) -> int:
    """Deletes files that end at or before a seq, but never the last; how many went."""
    path = local(path)
    names = sorted(x for x in os.listdir(path) if x.endswith(".log"))
    gone = [x for x in names[:-1] if int(x.split("-")[1]) <= least_seq]
    for x in gone:
        os.remove(os.path.join(path, x))
    return len(gone)
