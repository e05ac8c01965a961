"""Repeated substrings across documents, by an enhanced suffix array over anchors.

Every string of 50 bytes picks one of its 20-byte grams, the one with the least
hash, as its anchor; equal strings pick the same one at the same offset.  The
suffixes that start at anchors are a sparse suffix array in which every
repeat of 50 bytes still has a suffix.  It is dealt by the hash of the anchor, so all
suffixes that share a gram meet in one bucket:

1. Around an anchor lies its context, all the strings that picked it.  Contexts are compared
   by hash first: equal contexts form one class, and every document but the
   class's first loses the whole context.  A class goes on only with its first
   document, and only if another class of the gram shares the 15 bytes on
   its left or on its right, without which no common string of 50 bytes can hold the gram.
2. For what goes on, the bytes of the contexts are fetched.  In each bucket the suffixes
   are sorted, the array of common prefixes is scanned with a stack into the interval tree,
   and each interval's members are split by what precedes them: a set of
   members whose left and right extensions are both as long as they can be is a
   maximal repeat, put out with all its occurrences.

Defined results: null text is empty; rows without id never lose bytes and cause no loss; rows that
share an id are one document (what one of them loses, all lose, as far as their texts reach);
texts of under 50 bytes, empty tables and single documents lose nothing; texts of any length are
compared whole; a tie of ids is one document; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm import _tokens as tk
from tideline.llm._packing import groups_of, ids_of, packed, steps, unpacked
from tideline.llm._saved import marked, saved, tasks_for

LENGTH = 50
GRAM = 20
#: Bytes of input, about, for each bucket of grams or documents.
BUCKET_BYTES = 4 << 20
#: A string has LENGTH - GRAM bytes around its anchor, so this many on one side at least.
SIDE = (LENGTH - GRAM) // 2


def anchors(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All anchors of a slice: their documents (indices), the first of the strings that picked
    them, how many more did, the anchor's offset in it, and hashes of gram, context and sides."""
    n = len(data)
    none = {k: np.empty(0, np.int64) for k in ("doc", "lo", "more", "at", "h", "k")}
    if n < LENGTH:
        return none
    hashes = tk.Hashes(data)
    gram = hashes.grams(GRAM)
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    size = np.diff(offs)
    doc = np.repeat(np.arange(len(size)), np.maximum(0, size - LENGTH + 1))
    if not len(doc):
        return none
    p = np.arange(len(doc)) + np.repeat(np.where(size >= LENGTH, offs[:-1], 0) - np.append(0, np.cumsum(np.maximum(0, size - LENGTH + 1))[:-1]), np.maximum(0, size - LENGTH + 1))
    a = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.append(True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    a, lo, hi, doc = a[first], p[first], p[last], doc[first]
    k = hashes.spans(lo, hi + LENGTH) & np.uint64(0xFFFFFFFFFF)
    begin, end = offs[doc], offs[doc + 1]
    lone = tk.mix(a.astype(np.uint64))  # a side that is too short matches nothing
    left, right = a - SIDE >= begin, a + GRAM + SIDE <= end
    l = np.where(left, hashes.spans(np.where(left, a - SIDE, 0), np.where(left, a, 0)), lone)  # noqa: E741
    r = np.where(right, hashes.spans(np.where(right, a + GRAM, 0), np.where(right, a + GRAM + SIDE, 0)), ~lone)
    k |= (l >> np.uint64(52) << np.uint64(40)) | (r >> np.uint64(52) << np.uint64(52))
    return {"doc": doc, "lo": lo - begin, "more": hi - lo, "at": a - lo, "h": gram[a], "k": k}


ENTRIES = "bucket int, h binary, k binary, docs binary, starts binary, extra binary"


#: Anchors that a task gathers before it deals them out.
DEALT = 500_000


def _entries(documents: DataFrame, buckets: int) -> DataFrame:
    def dealt(found: list[tuple]) -> pa.RecordBatch:
        docs, starts, extra, h, k = (np.concatenate(c) for c in zip(*found, strict=True))
        to = (h % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        docs, starts, extra, h, k, to = docs[order], starts[order], extra[order], (h[order] >> np.uint64(32)).astype(np.uint32), k[order], to[order]
        cut = np.append(np.flatnonzero(_edges(to)), len(to)).tolist()
        of = list(zip(cut, cut[1:]))  # noqa: B905
        return pa.RecordBatch.from_arrays(
            [pa.array(to[cut[:-1]]), pa.array([h[i:j].tobytes() for i, j in of]), pa.array([k[i:j].tobytes() for i, j in of]), pa.array([steps(docs[i:j]) for i, j in of]), pa.array([packed(starts[i:j]) for i, j in of]), pa.array([packed(extra[i:j]) for i, j in of])],
            names=["bucket", "h", "k", "docs", "starts", "extra"],
        )

    def run(batches):
        found, n = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offs = tk.buffers(b.column(1))
            for first, _, part, part_offs in tk.slices(data, offs):
                x = anchors(part, part_offs)
                if len(x["doc"]):
                    found.append((ids[first + x["doc"]], x["lo"].astype(np.uint32), (x["more"] << 8 | x["at"]).astype(np.uint16), x["h"], x["k"]))
                    n += len(x["doc"])
                if n >= DEALT:
                    yield dealt(found)
                    found, n = [], 0
        if found:
            yield dealt(found)

    return documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, ENTRIES)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes; true at the start."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


CLASSES = "dbucket int, kind int, docs binary, starts binary, extra binary, keys binary"


def _by_document(kind: int, docs: np.ndarray, starts: np.ndarray, extra: np.ndarray, keys: np.ndarray | None, buckets: int) -> Iterator[tuple]:
    """Rows of packed entries, by the bucket of their documents."""
    if not len(docs):
        return
    to = dbucket(docs, buckets)
    order = np.lexsort((starts, docs, to))
    docs, starts, extra, to = docs[order], starts[order], extra[order], to[order]
    keys = None if keys is None else keys[order]
    cut = np.append(np.flatnonzero(_edges(to)), len(to)).tolist()
    for i, j in zip(cut, cut[1:]):  # noqa: B905
        yield int(to[i]), kind, steps(docs[i:j]), packed(starts[i:j]), packed(extra[i:j]), None if keys is None else keys[i:j].tobytes()


def dbucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (tk.mix(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, cols, strict=True)})


def _classes(bucket: int, rows: list[tuple], every: bool = False) -> tuple[tuple, tuple]:
    """Of one bucket: what equal contexts cover, and the contexts to be compared, those of later
    members of a class as well if every one is wanted; as columns (docs, starts, extra, keys)."""
    _, h, k, docs, starts, extra = zip(*rows, strict=True)
    h, k = np.frombuffer(b"".join(h), np.uint32), np.frombuffer(b"".join(k), np.uint64)
    docs, starts, extra = ids_of(docs), unpacked(starts, np.uint32), unpacked(extra, np.uint16)
    order = np.argsort(h, kind="stable")
    same = h[order]
    # Grams of one document only are most; they go before the finer sort.
    first = np.flatnonzero(_edges(same))
    size = np.diff(np.append(first, len(same)))
    order = order[np.repeat((size > 1) & (np.minimum.reduceat(docs[order], first) < np.maximum.reduceat(docs[order], first)), size)]
    h, k, docs, starts, extra = h[order], k[order], docs[order], starts[order], extra[order]
    order = np.lexsort((docs, k, h))
    h, k, docs, starts, extra = h[order], k[order], docs[order], starts[order], extra[order]
    first = np.flatnonzero(_edges(h, k))
    size = np.diff(np.append(first, len(h)))
    later = docs > np.repeat(docs[first], size)  # than the class's first document
    keep = np.zeros(len(first), bool)
    ch, ck = h[first], k[first]
    for shift in (40, 52):  # classes of a gram that share a side
        side = (ck >> np.uint64(shift)) & np.uint64(0xFFF)
        by = np.lexsort((side, ch))
        start = _edges(ch[by], side[by])
        keep[by] |= ~(start & np.append(start[1:], True))
    ask = np.repeat(keep, size) & ~later | every
    keys = h.astype(np.int64) | (bucket << 32)
    return (docs[later], starts[later], (extra[later] >> 8) + np.uint16(LENGTH), keys[later]), (docs[ask], starts[ask], extra[ask], keys[ask])


#: Entries that a task holds before it writes them out by document.
HELD = 1_000_000


def _classed(entries: DataFrame, buckets: int, every: bool) -> DataFrame:
    """Rows of kind 0 (covered) and 1 (to be compared), from all buckets of a task together."""

    def run(batches):
        held: list[list[tuple]] = [[], []]

        def flush():
            for kind in (0, 1):
                docs, starts, extra, keys = (np.concatenate(c) for c in zip(*held[kind], strict=True))
                held[kind].clear()
                yield from _table(list(_by_document(kind, docs, starts, extra, keys if kind else None, buckets)), CLASSES).to_batches()

        for rows in groups_of(batches):
            for kind, x in enumerate(_classes(rows[0][0], rows, every)):
                held[kind].append(x)
            if sum(len(x[0]) for kind in held for x in kind) > HELD:
                yield from flush()
        if held[0]:
            yield from flush()

    return entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, CLASSES)


CONTEXTS = "key long, doc long, start long, at int, context binary"


def _texts(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    for doc, text in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
        yield doc, (text or "").encode()


def _contexts(documents: pa.Table, asked: pa.Table) -> pa.Table:
    """Of one bucket of documents the contexts asked for."""
    col = lambda c: asked.column(c).to_pylist()
    docs, starts, extra, keys = ids_of(col("docs")), unpacked(col("starts"), np.uint32), unpacked(col("extra"), np.uint16), np.frombuffer(b"".join(col("keys")), np.int64)
    order = np.argsort(docs, kind="stable")
    docs, starts, extra, keys = docs[order], starts[order].astype(np.int64), extra[order].astype(np.int64), keys[order]
    out: list[tuple] = []
    seen = set()
    for doc, text in _texts(documents):
        i, j = np.searchsorted(docs, doc, "left"), np.searchsorted(docs, doc, "right")
        if i == j or (doc, text) in seen:
            continue
        seen.add((doc, text))
        for key, start, x in zip(keys[i:j].tolist(), starts[i:j].tolist(), extra[i:j].tolist(), strict=True):
            end = start + (x >> 8) + LENGTH
            if end <= len(text):
                out.append((key, doc, start, x & 255, text[start:end]))
    return _table(out, CONTEXTS)


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """The interval tree of common prefixes, children first: (common length, first, last)
    over leaves 0..len(lcp), where lcp[i] is common to leaves i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i in range(len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        first = i
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


class Strings:
    """Short byte strings as rows of a matrix, with their order and common prefixes."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings])
        width = max(1, int(self.size.max()))
        self.rows = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
        self.order = np.array(sorted(range(len(strings)), key=strings.__getitem__))
        self.rank = np.empty(len(strings), np.int64)
        self.rank[self.order] = np.arange(len(strings))

    def lcp(self, order: np.ndarray) -> list[int]:
        """Lengths common to neighbours in an order."""
        x, y = order[:-1], order[1:]
        differ = self.rows[x] != self.rows[y]
        common = np.where(differ.any(1), differ.argmax(1), differ.shape[1])
        return np.minimum(common, np.minimum(self.size[x], self.size[y])).tolist()


def maximal_repeats(before: list[bytes], after: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats through one point of each string: (bytes before, bytes after, members).

    before: what precedes the point, backwards; after: the suffix from the point.
    """
    left, right = Strings(before), Strings(after)
    deepest = int(left.size.max())
    inner: list[tuple[int, int]] = []  # intervals within the one that is looked at
    for after_n, i, j in intervals(right.lcp(right.order)):
        children = [x for x in inner if x[0] >= i]
        inner = [x for x in inner if x[0] < i] + [(i, j)]
        if after_n + deepest < length:
            continue
        child = np.arange(i, j + 1)  # a leaf stands for itself unless a child interval holds it
        for x, y in children:
            child[x - i : y + 1 - i] = x
        members = right.order[i : j + 1]
        by_left = np.argsort(left.rank[members], kind="stable")
        members, child = members[by_left], child[by_left]
        for before_n, x, y in intervals(left.lcp(members)):
            if before_n + after_n >= length and (child[x : y + 1] != child[x]).any():
                yield before_n, after_n, members[x : y + 1]


def _repeats_of(rows: list[tuple]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Of the contexts of one gram the repeats over several documents: length, (doc, start)."""
    if len({r[1] for r in rows}) < 2:
        return
    for before_n, after_n, members in maximal_repeats([r[4][: r[3]][::-1] for r in rows], [r[4][r[3] :] for r in rows]):
        places = sorted((rows[m][1], rows[m][2] + rows[m][3] - before_n) for m in members.tolist())
        if places[0][0] != places[-1][0]:
            yield before_n + after_n, places


def _compared(contexts: DataFrame, buckets: int) -> DataFrame:
    """What the maximal repeats of each bucket cover, as rows of kind 0."""

    def run(batches):
        held: list[tuple[int, int, int]] = []

        def flush():
            docs, starts, sizes = (np.array(c, np.int64) for c in zip(*held, strict=True))
            t = _table(list(_by_document(0, docs, starts.astype(np.uint32), sizes.astype(np.uint16), None, buckets)), CLASSES)
            held.clear()
            return t.to_batches()

        for rows in groups_of(batches):
            for size, places in _repeats_of(rows):
                held.extend((doc, start, size) for doc, start in places if doc > places[0][0])
            if len(held) > HELD // 4:
                yield from flush()
        if held:
            yield from flush()

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, CLASSES)


def repeat_groups(documents: DataFrame) -> DataFrame:
    """The maximal repeats of at least 50 bytes over several documents, with all occurrences
    of each: repeat (its key), length, doc_id, start (in bytes).  A repeat that goes on beyond
    the strings of one anchor is put out in overlapping pieces, one for each of its anchors."""

    def run(batches):
        for rows in groups_of(batches):
            out = []
            for n, (size, places) in enumerate(_repeats_of(rows)):
                name = hashlib.blake2b(f"{rows[0][0]}/{n}".encode(), digest_size=8).hexdigest()
                out += [(name, size, doc, start) for doc, start in places]
            if out:
                yield from _table(out, GROUPS).to_batches()

    docs, classes, buckets = _found(documents, every=True)
    return _asked(docs, classes, buckets).repartition("key").sortWithinPartitions("key").mapInArrow(run, GROUPS)


GROUPS = "repeat string, length long, doc_id long, start long"


def _docs_of(classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(ids_of(b.column(0).to_pylist())))], names=["__id"])

    return classes.select("docs").mapInArrow(run, "__id long")


def _placed(docs: DataFrame, buckets: int) -> DataFrame:
    """The documents with the bucket that dbucket() gives them."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(dbucket(ids, buckets)), *b.columns], names=["dbucket", "doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "dbucket int, doc_id long, text string")


def _found(documents: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """The documents' ids and texts, rows of CLASSES, and the number of buckets of documents."""
    parts = tasks_for(documents, BUCKET_BYTES)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs, saved(_classed(_entries(docs, parts), parts, every)), parts


def _asked(docs: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    asked = classes.where("kind = 1")
    some = marked(docs, "doc_id", _docs_of(asked), "__id").where("__maybe and doc_id is not null")
    return _placed(some, buckets).groupBy("dbucket").cogroup(asked.groupBy("dbucket")).applyInArrow(_contexts, CONTEXTS)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(documents: pa.Table, spans: pa.Table) -> pa.Table:
    """Of one bucket of documents what is left of each."""
    col = lambda c: spans.column(c).to_pylist()
    docs, starts, sizes = ids_of(col("docs")), unpacked(col("starts"), np.uint32).astype(np.int64), unpacked(col("extra"), np.uint16).astype(np.int64)
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], (starts + sizes)[order]
    out = []
    for doc, text in _texts(documents):
        i, j = np.searchsorted(docs, doc, "left"), np.searchsorted(docs, doc, "right")
        change = np.zeros(len(text) + 1, np.int32)
        np.add.at(change, np.minimum(starts[i:j], len(text)), 1)
        np.add.at(change, np.minimum(ends[i:j], len(text)), -1)
        gone = np.cumsum(change)[: len(text)] > 0
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out.append((doc, len(text), int(gone.sum()), int(_edges_of_runs(gone)), hashlib.sha256(kept).hexdigest()))
    return _table(out, DIGEST)


def _edges_of_runs(gone: np.ndarray) -> int:
    return int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0


def removals(documents: DataFrame) -> DataFrame:
    """Per document what goes: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs, classes, buckets = _found(documents)
    contexts = _asked(docs, classes, buckets)
    spans = saved(classes.where("kind = 0").unionByName(_compared(contexts, buckets)).select("dbucket", "docs", "starts", "extra"))
    rows = marked(docs, "doc_id", _docs_of(spans), "__id").withColumn("__maybe", F.col("__maybe") & F.col("doc_id").isNotNull())
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = rows.where("not __maybe").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    some = _placed(rows.where("__maybe"), buckets)
    return whole.unionByName(some.groupBy("dbucket").cogroup(spans.groupBy("dbucket")).applyInArrow(_cut, DIGEST))
