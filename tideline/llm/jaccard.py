"""N-gram Jaccard join with count vectors: components of near-equal documents.

A document is the set of its distinct 3-word shingles (as 64-bit hashes).

1. Documents with equal sets form a class, and only classes are compared.
2. Candidates: two sets that link differ in at most d = (|A| + |B|) / 19 shingles.  The
   range of hashes is cut into d + 1 + e groups (d for the largest set of a band of
   sizes), so linked sets agree exactly in at least 1 + e groups, of which one isn't empty if either
   has at most e empty ones.  Sets are matched on hashes of whole groups, of empty ones only if
   they have more than e; a set just below a band takes part in it too.
3. Count vectors: shingles are hashed into 256 groups, a set is the point of its
   group counts.  The overlap of two sets is at most the sum of the coordinates'
   minima.  Sets that met are searched through an R-tree of these points, whose boxes give the
   same bound for all points in them; pairs that can't reach the overlap go.
4. The rest are verified on the sets themselves.  First each gathering is
   compared with its central set, which joins groups of copies without all their pairs; what
   is then still in different components is searched through the R-tree, best
   bounds first, until no untested pair could link two components.  Large gatherings are dealt in parts.

Defined results: text without words is linked with nothing; null ids take no part and get no
component; rows that share an id are one document, which links with whatever any of them links with;
fewer than 3 words are one shingle; texts of any length are read whole; other columns are not looked at;
an empty table gives an empty result; ties cannot arise.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tideline.llm import _tokens as tk
from tideline.llm._packing import ids_of, long, packed, short, steps, unpacked
from tideline.llm._saved import least_labels, marked, released, saved, tasks_for

SHINGLE = 3
#: Linked: DEN * intersection >= NUM * union.
NUM, DEN = 90, 100
#: Few enough for boxes to bound, enough that a lost and a new shingle seldom share a group.
DIMENSIONS = 256
#: Sizes of sets from which bands start: each half as large again.
BANDS = [1, 10]
while BANDS[-1] < 1 << 40:
    BANDS.append(-(-BANDS[-1] * 3 // 2))
#: Members of a gathering that are searched at once.  Larger ones are dealt in parts of half as many, each
#: with the same ANCHORS first members, which near copies link with; what is in several components
#: even then is searched against all parts.
BLOCK, ANCHORS = 1024, 32
#: Bytes of input, about, for each bucket of signatures.
BUCKET_BYTES = 2 << 20
#: Best partners for a set in one round; None: all that are left.
ROUNDS = (16, None)
#: Bytes of a signature that travel, next to the number of its bucket.
SIGNATURE = 6


def differences(size: int) -> int:
    """How many shingles at most differ between linked sets of at most this size."""
    return 2 * size * (DEN - NUM) // (DEN + NUM)


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of linked sets of these sizes."""
    return -(-NUM * (a + b) // (DEN + NUM))


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offs = tk.buffers(texts)
    blank = tk.table("blank")
    for first, last, part, part_offs in tk.slices(data, offs):
        part = tk.lower(part)
        start, end, word_offs = tk.words(part, part_offs, blank)
        hashes = tk.Hashes(part).spans(start, end) if len(start) else np.empty(0, np.uint64)
        grams = tk.ngram_hashes(hashes, SHINGLE)
        for d in range(last - first):
            a, b = word_offs[d], word_offs[d + 1]
            if b - a >= SHINGLE:
                s = np.sort(grams[a : b - SHINGLE + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                yield tk.mix(tk.ngram_hashes(hashes[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)


def group_sums(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n equal ranges of hashes the sum of its members' mixed hashes, and their number."""
    of = ((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    cut = np.searchsorted(of, np.arange(n + 1, dtype=np.uint64))
    sums = np.append(np.uint64(0), np.cumsum(tk.mix(s ^ np.uint64(0x94D049BB133111EB)), dtype=np.uint64))
    return sums[cut[1:]] - sums[cut[:-1]], np.diff(cut)


def spare(groups: int) -> int:
    """How many groups may be empty in a set before its empty ones are matched as well."""
    return 1 + groups // 16


def signatures(s: np.ndarray) -> np.ndarray:
    """Hashes of the groups of a set, for its band and, if it's near enough, the next."""
    n, out = len(s), []
    if not n:
        return np.empty(0, np.uint64)
    own = int(np.searchsorted(BANDS, n, "right")) - 1
    for band in (own, own + 1):
        least = differences(BANDS[band + 1] - 1) + 1
        if least < 2 or (band > own and DEN * n < NUM * BANDS[band]):
            continue  # equal sets are one class already
        groups = least + spare(least)
        sums, sizes = group_sums(s, groups)
        names = tk.mix(sums ^ tk.mix(np.arange(groups, dtype=np.uint64) + np.uint64(band << 40)))
        out.append(names[sizes > 0] if (sizes == 0).sum() <= spare(least) else names)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


PRINT = "doc_id long, n long, k1 long, k2 long, vec binary, bucket int, sigs binary, docs binary, kinds binary"


def _prints(documents: DataFrame, buckets: int) -> DataFrame:
    """A row for each document, and rows of packed signatures for each bucket."""

    def run(batches):
        for b in batches:
            ids, n = b.column(0).to_pylist(), len(b)
            size, k1, k2, vecs = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), []
            seen: dict[tuple[int, int, int], tuple[int, np.ndarray]] = {}
            for i, s in enumerate(sets(b.column(1))):
                size[i] = len(s)
                vecs.append(packed(group_sums(s, DIMENSIONS)[1].astype(np.uint32)))
                if not len(s):
                    continue
                k1[i], k2[i] = s.sum(dtype=np.uint64), np.bitwise_xor.reduce(tk.mix(s))
                if ids[i] is None:
                    continue
                key = (len(s), int(k1[i]), int(k2[i]))
                if key in seen:  # of equal sets in a batch the first is enough
                    seen[key] = min(seen[key][0], ids[i]), seen[key][1]
                else:
                    seen[key] = ids[i], signatures(s)
            out = {"doc_id": b.column(0), "n": pa.array(size), "k1": pa.array(k1.view(np.int64)), "k2": pa.array(k2.view(np.int64)), "vec": pa.array(vecs, pa.binary())}
            yield pa.RecordBatch.from_arrays([*out.values(), *(pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=names)
            if not seen:
                continue
            lengths = [len(x[1]) for x in seen.values()]
            sigs = np.concatenate([x[1] for x in seen.values()])
            docs = np.repeat(np.array([x[0] for x in seen.values()], np.int64), lengths)
            kinds = np.repeat(np.array([k[1] ^ k[2] for k in seen], np.uint64), lengths)
            to = (sigs % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((docs, to))
            sigs, docs, kinds, to = sigs[order], docs[order], kinds[order], to[order]
            at = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)) if len(to) else np.zeros(1, int)
            pairs = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            blob = lambda x, pack: pa.array([pack(x[a:e]) for a, e in pairs], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())), pa.array(to[at[:-1]]), blob(sigs, lambda x: short(x, SIGNATURE)), blob(docs, steps), blob(kinds, bytes)], names=names)

    names = [x.split()[0] for x in PRINT.split(", ")]
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PRINT)


GATHERED = "lid long, gid long, members binary"


def _gathered(both: DataFrame, block: int) -> DataFrame:
    """Documents that share a signature and aren't of one class: each list once, by its hash.  gid names
    the gathering that a list is a part of, if it isn't whole."""

    def run(table):
        col = lambda name: table.column(name).to_pylist()
        sigs, docs, kinds = long(b"".join(col("sigs")), SIGNATURE), ids_of(col("docs")), np.frombuffer(b"".join(col("kinds")), np.uint64)
        order = np.lexsort((docs, kinds, sigs))
        sigs, docs, kinds = sigs[order], docs[order], kinds[order]
        new = np.append(True, sigs[1:] != sigs[:-1]) if len(sigs) else np.empty(0, bool)
        first = np.flatnonzero(new | np.append(True, kinds[1:] != kinds[:-1])) if len(sigs) else np.empty(0, int)
        sigs, docs = sigs[first], docs[first]  # the least document of each class
        cut = np.append(np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1])), len(sigs)) if len(sigs) else np.zeros(1, int)
        length = np.diff(cut)
        lists: dict[bytes, int | None] = {}
        two = cut[:-1][length == 2]
        if len(two):
            lists.update(dict.fromkeys(x.tobytes() for x in np.unique(np.sort(np.stack([docs[two], docs[two + 1]], 1), 1), axis=0)))
        for g in np.flatnonzero(length > 2):
            members = np.unique(docs[cut[g] : cut[g + 1]])
            if len(members) <= block:
                lists[members.tobytes()] = None
            else:
                gid = hash_of(members.tobytes())
                for i in range(0, len(members), block // 2):
                    lists[np.union1d(members[:ANCHORS], members[i : i + block // 2]).tobytes()] = gid
        out = [x for x in lists if len(x) > 8]
        return pa.table({"lid": pa.array([hash_of(x) for x in out], pa.int64()), "gid": pa.array([lists[x] for x in out], pa.int64()), "members": pa.array(out, pa.binary())})

    rows = both.where("bucket is not null").select("bucket", "sigs", "docs", "kinds")
    return rows.groupBy("bucket").applyInArrow(run, GATHERED).groupBy("lid").agg(F.max("gid").alias("gid"), F.first("members").alias("members"))


def hash_of(members: bytes) -> int:
    words = np.frombuffer(members, np.uint64)
    return int(tk.mix(np.array([(tk.mix(words) * (2 * np.arange(len(words), dtype=np.uint64) + np.uint64(1))).sum(dtype=np.uint64)]))[0].view(np.int64))


def _explode(members: DataFrame) -> DataFrame:
    """lid, doc: a row for each member of each list."""

    def run(batches):
        for b in batches:
            lists = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(x) for x in lists])), pa.array(np.concatenate(lists))], names=["lid", "doc"])

    return members.mapInArrow(run, "lid long, doc long")


class RTree:
    """Points packed into boxes by sorting on the widest coordinate, level by level."""

    LEAF = 32

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.nodes: list[tuple[np.ndarray, int, list[int] | np.ndarray]] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray) -> int:
        box = self.points[at].max(0)
        least = int(self.sizes[at].min())
        if len(at) <= self.LEAF:
            self.nodes.append((box, least, at))
        else:
            wide = int(np.argmax(box - self.points[at].min(0)))
            order = at[np.argsort(self.points[at, wide], kind="stable")]
            half = len(order) // 2
            kids = [self._build(order[:half]), self._build(order[half:])]
            self.nodes.append((box, least, kids))
        return len(self.nodes) - 1

    def search(self, point: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Points whose bound reaches the overlap that a link needs, and by how much."""
        found, spare, work = [], [], [self.root]
        while work:
            box, least, kids = self.nodes[work.pop()]
            if np.minimum(point, box).sum() < needed(size, max(least, -(-NUM * size // DEN))):
                continue
            if isinstance(kids, list):
                work += kids
            else:
                over = np.minimum(point, self.points[kids]).sum(1) - needed(size, self.sizes[kids])
                found.append(kids[over >= 0])
                spare.append(over[over >= 0])
        return (np.concatenate(found), np.concatenate(spare)) if found else (np.empty(0, np.int64),) * 2


def central_pairs(docs: np.ndarray, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The member next to the median point, with each member that may link with it."""
    middle = np.median(points, axis=0)
    centre = int(np.argmin(np.abs(points - middle).sum(1)))
    at, _ = RTree(points, sizes).search(points[centre], sizes[centre])
    at = at[docs[at] != docs[centre]]
    return np.full(len(at), docs[centre]), docs[at]


def crossing_pairs(docs: np.ndarray, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Members outside the largest component, each with its best partners in other components."""
    names, counts = np.unique(labels, return_counts=True)
    if len(names) < 2:
        return (np.empty(0, np.int64),) * 2
    tree, a, b = RTree(points, sizes), [], []
    for i in np.flatnonzero(labels != names[np.argmax(counts)]):
        at, spare = tree.search(points[i], sizes[i])
        other = labels[at] != labels[i]
        at, spare = at[other], spare[other]
        if most is not None:
            at = at[np.argsort(-spare, kind="stable")[:most]]
        a.append(np.full(len(at), docs[i]))
        b.append(docs[at])
    return np.concatenate(a), np.concatenate(b)


def _pairs(lists: DataFrame, choose) -> DataFrame:
    """Distinct pairs (a < b) that `choose` takes from each list of lid, doc, label, n, vec."""

    def run(batches):
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            lids = t.column("lid").to_numpy()
            if not len(lids):
                continue
            whole = int(np.searchsorted(lids, lids[-1]))  # the last list may go on in the next batch
            rest = t.slice(whole)
            yield from each(t.slice(0, whole))
        if rest is not None:
            yield from each(rest)

    def each(t: pa.Table):
        if not t.num_rows:
            return
        lids, docs, labels, n = (t.column(c).to_numpy() for c in ("lid", "doc", "label", "n"))
        points = unpacked(t.column("vec").to_pylist(), np.uint32).reshape(-1, DIMENSIONS).astype(np.int64)
        cut = np.append(np.flatnonzero(np.append(True, lids[1:] != lids[:-1])), len(lids))
        a, b = [], []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            x, y = choose(docs[i:j], points[i:j], n[i:j], labels[i:j])
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    rows = lists.select("lid", "doc", "label", "n", "vec").repartition("lid").sortWithinPartitions("lid")
    return rows.mapInArrow(run, "a long, b long").distinct()


#: Partners that one task compares with a copy of one set.
PARTNERS = 256
SENT = "home long, salt int, is_home boolean, doc long, shingles binary"


def _verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, on the sets themselves.

    Sets of b travel to a; where very many do, they are dealt over several salts,
    and a's set goes to each of them.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("salts"))
    dealt = pairs.join(many, "a")
    wanted = saved(
        dealt.select(F.col("b").alias("__id"), F.col("a").alias("home"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("is_home"))
        .unionByName(many.select(F.col("a").alias("__id"), F.col("a").alias("home"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("is_home")))
    )
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = marked(docs, "doc_id", wanted, "__id").where("__maybe").select("doc_id", "text")

    def shingled(batches):
        for b in batches:
            texts = b.column(4)
            # Rows of one text come one after another, and it is cut up once.
            new = np.append(True, ~np.asarray(pc.equal(texts[1:], texts[:-1]).fill_null(True))) if len(b) else np.empty(0, bool)
            own = [short(s, 7) for s in sets(texts.filter(pa.array(new)))]
            blobs = [own[i] for i in np.cumsum(new) - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(blobs, pa.binary())], names=["home", "salt", "is_home", "doc", "shingles"])

    sent = docs.join(wanted, F.col("doc_id") == F.col("__id")).select("home", "salt", "is_home", "doc_id", "text").mapInArrow(shingled, SENT)
    sent = sent.repartition("home", "salt").sortWithinPartitions("home", "salt", F.desc("is_home"))

    def compare(batches):
        key, homes = None, []
        for b in batches:
            a_out, b_out = [], []
            for home, salt, is_home, doc, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (home, salt) != key:
                    key, homes = (home, salt), []
                s = long(blob, 7)
                if is_home:
                    homes.append(s)
                    continue
                for h in homes:
                    at = np.minimum(np.searchsorted(h, s), len(h) - 1)
                    common = int((h[at] == s).sum())
                    if DEN * common >= NUM * (len(h) + len(s) - common):
                        a_out.append(home)
                        b_out.append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return sent.mapInArrow(compare, "a long, b long").distinct()


def _classes(prints: DataFrame) -> DataFrame:
    """Equal sets, each with its least document."""
    return prints.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("least"))


def _same_id(prints: DataFrame) -> DataFrame:
    """Links (a, b) of ids that have several sets with the first members of these sets' classes."""
    rows = prints.where("n > 0 and doc_id is not null").select("doc_id", "n", "k1", "k2")
    several = rows.groupBy("doc_id").agg(*[f(c).alias(f"{c}{i}") for c in ("n", "k1", "k2") for i, f in enumerate((F.min, F.max))])
    several = several.where("n0 <> n1 or k10 <> k11 or k20 <> k21").select("doc_id")
    return rows.join(several, "doc_id").distinct().join(_classes(prints), ["n", "k1", "k2"]).where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))


def _across(rows: DataFrame, half: int) -> DataFrame:
    """Of large gatherings (lid, doc, label) that are in several components, lists (lid, doc, label) that
    hold each member outside the gathering's largest component together with each member at all."""
    sizes = rows.groupBy("lid", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("lid").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("open"))
    main = main.where("open > 0").select("lid", "main", F.ceil(F.col("open") / half).alias("chunks"), F.ceil(F.col("all") / half).alias("parts"))
    rows = rows.join(main, "lid").withColumns({"chunk": F.pmod(F.xxhash64("doc"), F.col("chunks")), "part": F.pmod(F.xxhash64("doc", F.lit(1)), F.col("parts"))})
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = rows.where("label <> main").select("lid", "chunk", upto("parts").alias("part"), "doc", "label")
    told = rows.select("lid", upto("chunks").alias("chunk"), "part", "doc", "label")
    return asked.unionByName(told).select(F.xxhash64("lid", "chunk", "part").alias("lid"), "doc", "label").distinct()


def components(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    buckets = tasks_for(documents, BUCKET_BYTES)
    both = saved(_prints(documents, buckets))
    prints = both.where("bucket is null").select("doc_id", "n", "k1", "k2", "vec")
    lists = saved(_gathered(both, block))
    points = prints.where("doc_id is not null and n > 0").select("doc_id", "n", "vec").distinct()
    members = saved(_explode(lists.select("lid", "members")))

    def pairs(rows: DataFrame, choose) -> DataFrame:
        return _pairs(rows.join(points, F.col("doc") == F.col("doc_id")).select("lid", "doc", "label", "n", "vec"), choose)

    tested = saved(pairs(members.withColumn("label", F.col("doc")), central_pairs))
    links = saved(_verified(documents, tested).unionByName(_same_id(prints)))
    labels = least_labels(links)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, F.col("doc") == F.col("node"), "left").select("lid", "doc", F.coalesce("label", "doc").alias("label"))

    def search(rows: DataFrame, most: int | None) -> None:
        nonlocal tested, links, labels
        found = saved(pairs(rows, lambda d, p, n, g: crossing_pairs(d, p, n, g, most)).join(tested, ["a", "b"], "left_anti"))
        if not found.limit(1).count():
            return
        more = saved(_verified(documents, found))
        tested = tested.unionByName(found)
        if more.limit(1).count():
            links = links.unionByName(more)
            labels = least_labels(links)

    for most in ROUNDS:
        now = labelled(members)
        open_ = now.groupBy("lid").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("lid")
        search(now.join(open_, "lid"), most)
    large = lists.where("gid is not null").select(F.col("gid").alias("lid"), "members")
    if large.limit(1).count():
        large = saved(_explode(large).distinct())
        for most in ROUNDS:
            search(_across(labelled(large), block // 2), most)
    released(members)
    released(lists)
    classes = _classes(prints).join(labels, F.col("least") == F.col("node"), "left").select(F.col("n").alias("cn"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.coalesce("label", "least").alias("label"))
    out = prints.join(classes, (F.col("n") == F.col("cn")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents without those that a document with a smaller id stands for, columns unchanged.

    Rows without id stay.  Of rows that share an id and, but for case and blanks, the text, the first by
    text stays, then by a hash of the row; others that share an id all stay.  Only rows that may go, or
    whose id repeats, are shuffled.
    """
    found = saved(components(documents))
    gone = found.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("gone"))
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    rows = marked(rows, "id", gone.unionByName(twice), "gone")
    sure = rows.where("not __maybe or id is null").select("row")
    maybe = rows.where("__maybe and id is not null").select("id", "row").join(gone, F.col("id") == F.col("gone"), "left_anti")
    small = F.translate(F.col("row.text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    said = F.array_join(F.array_remove(F.split(small, "[\\x20\\x09-\\x0D]+"), ""), " ")
    whole = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in documents.schema if "map<" not in f.dataType.simpleString()])
    first = F.row_number().over(Window.partitionBy("id", F.coalesce(said, F.lit(""))).orderBy("row.text", whole))
    return sure.unionByName(maybe.withColumn("first", first).where("first = 1").select("row")).select("row.*")
