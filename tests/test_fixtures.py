"""Small logs, leases and registries with known outcomes."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import clock, discovery, lease, replica, segments, state, watch
from tideline.sources import log as logs, snapshot

LOG = "seq long, revision long, phys_ms long, logical int, node_id string, op string, key string, value string"


def log_of(spark, *rows):
    """rows: (phys_ms, op, key, value)"""
    return spark.createDataFrame([(i, i, p, 0, "n", op, k, v) for i, (p, op, k, v) in enumerate(rows, 1)], LOG)


def kv(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_revisions_are_gapless(spark):
    rows = spark.range(50).select(F.col("id").alias("at")).repartition(7)
    got = logs.append(100, rows, "at").orderBy("at").collect()
    assert [(r["at"], r["seq"], r["revision"]) for r in got] == [(i, 101 + i, 101 + i) for i in range(50)]


@pytest.mark.parametrize(
    ("rows", "start", "prefix", "want"),
    [
        ([], 0, "a", []),
        ([(1, "SET", "x", "1")], 1000, "x", []),
        ([(1, "SET", "x1", "1"), (2, "SET", "x2", "1"), (3, "SET", "x3", "1")], 0, "x", [("Set", "x1"), ("Set", "x2"), ("Set", "x3")]),
        ([(1, "SET", "foo1", "1"), (2, "SET", "bar1", "1"), (3, "SET", "foo2", "1")], 2, "foo", [("Set", "foo2")]),
        ([(1, "SET", "x", "1"), (2, "DEL", "x", None)], 1, "x", [("Delete", "x")]),
        ([(1, "SET", "k", "1"), (2, "SET", "k", "2"), (3, "DEL", "k", None)], 1, "k", [("Set", "k"), ("Delete", "k")]),
        ([(1, "SET", "foo1", "1"), (2, "SET", "foa", "1"), (3, "SET", "fax", "1")], 0, "fo", [("Set", "foo1"), ("Set", "foa")]),
    ],
)
def test_replay(spark, rows, start, prefix, want):
    got = logs.replay(log_of(spark, *rows), start, prefix).orderBy("seq").collect()
    assert [(r["kind"], r["key"]) for r in got] == want


def test_state(spark):
    log = log_of(spark, (10, "SET", "user:1", "A"), (11, "SET", "user:2", "B"), (12, "SET", "order:1", "X"))
    assert kv(state.prefix_scan(log, "user:")) == {"user:1": "A", "user:2": "B"}
    log = log_of(spark, (10, "SET", "key:1", "A"), (11, "SET", "key:2", "B"), (12, "DEL", "key:1", None))
    assert kv(state.prefix_scan(log, "key:")) == {"key:2": "B"} and state.get(log, "key:1").count() == 0
    assert state.get_item(log, "key:1").first()["value"] is None
    log = log_of(spark, (2000, "SET", "x", "NEW"), (1000, "SET", "x", "OLD"))
    assert kv(state.latest(log)) == {"x": "NEW"}
    log = log_of(spark, (5, "SET", "x", "first"), (5, "SET", "x", "second"))
    assert kv(state.latest(log)) == {"x": "first"}  # equal timestamps: the first stays
    log = log_of(spark, (1, "SET", "a/b/c", "1"), (2, "SET", "a/b/d", "1"), (3, "SET", "a/x", "1"))
    assert [r["key"] for r in state.prefix_scan(log, "a/b").collect()] == ["a/b/c", "a/b/d"]
    assert state.prefix_scan(log, "beta").count() == 0
    log = log_of(spark, (10, "SET", "k", "v"), (5, "DEL", "k", None))  # a stale delete
    assert kv(state.prefix_scan(log, "k")) == {"k": "v"} and state.arrival_visible(log, "k").count() == 0


def test_binary_prefix(spark):
    rows = spark.createDataFrame([(bytearray(b),) for b in (b"a", b"a\xff", b"a\xff\xff", b"b", b"\xff", b"\xff\xff")], "key binary")
    for p in (b"a", b"a\xff", b"\xff", b""):
        got = {bytes(r[0]) for r in rows.where(logs.under(F.col("key"), p)).collect()}
        assert got == {b for b in (b"a", b"a\xff", b"a\xff\xff", b"b", b"\xff", b"\xff\xff") if b.startswith(p)}


def test_order_does_not_matter(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), rng.choice(["SET", "DEL"]), f"k{rng.randrange(9)}") for _ in range(200)]
    log = [(i, i, p, i, "n", op, k, None if op == "DEL" else str(i)) for i, (p, op, k) in enumerate(rows, 1)]
    whole = sorted(map(tuple, state.latest(spark.createDataFrame(log, LOG)).collect()), key=str)
    rng.shuffle(log)
    assert sorted(map(tuple, state.latest(spark.createDataFrame(log + log[:50], LOG)).collect()), key=str) == whole
    last = state.changes(spark.createDataFrame(log, LOG)).groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    assert kv(last) == kv(spark.createDataFrame(whole, state.latest(spark.createDataFrame(log, LOG)).schema))


def test_compare_and_set(spark):
    rows = [(1, "a", 0, "SET"), (2, "a", 0, "SET"), (3, "a", 1, "SET"), (4, "k", 9, "SET"), (5, "k", 0, "DEL"), (6, "k", 5, "SET"), (7, "k", 0, "SET")]
    got = state.compare_and_set(spark.createDataFrame(rows, "req_seq long, key string, expected long, op string")).orderBy("req_seq").collect()
    assert [r["accepted"] for r in got] == [True, False, True, False, True, True, False]


def test_clocks_follow_a_fold(spark):
    rng = random.Random(4)
    rows, want = [], []
    for node in ("a", "b"):
        p = n = None
        for i in range(300):
            now = 1000 + i // 3 + rng.randrange(-4, 4)
            r = (now + rng.randrange(-3, 4), rng.randrange(6)) if rng.random() < 0.5 else (None, None)
            rows.append((len(rows), node, now, *r))
            if p is None:
                p, n = now, -1
            new = max(now, p, r[0] if r[0] is not None else now)
            n = max(n, r[1]) + 1 if new == p == r[0] else n + 1 if new == p else r[1] + 1 if new == r[0] else 0
            p = new
            want.append((p, n))
    df = spark.createDataFrame(rows, "i long, node string, now long, rp long, rl int")
    got = clock.on_receive(df, "now", "rp", "rl", "node", "i").orderBy("i").collect()
    assert [(r["hlc_phys"], r["hlc_logical"]) for r in got] == want
    local = clock.next_local(df, "now", "node", "i").orderBy("i").collect()
    p = n = node = None
    for r in local:
        if r["node"] != node:
            node, p, n = r["node"], r["now"] - 1, 0
        p, n = (r["now"], 0) if r["now"] > p else (p, n + 1)
        assert (r["hlc_phys"], r["hlc_logical"]) == (p, n)


EVENTS = "seq long, lease_id long, kind string, now_ms long, ttl_ms long"


def test_leases(spark):
    at = lambda events, t: lease.expired_at(lease.latest_leases(spark.createDataFrame(events, EVENTS)), t).count()
    one = [(1, 1, "create", 0, 100)]
    assert (at(one, 50), at(one, 150), at(one, 100)) == (0, 1, 1)
    two = [*one, (2, 1, "renew", 90, 200)]
    assert (at(two, 150), at(two, 320)) == (0, 1)
    assert at([(1, 1, "create", 0, 10_000), (2, 1, "revoke", 1, None)], 99_999) == 0
    events = [(1, 1, "keepalive", 0, 5), (2, 1, "create", 0, 100), (3, 1, "keepalive", 99, None), (4, 1, "keepalive", 150, 0), (5, 1, "keepalive", 199, None), (6, 1, "keepalive", 200, None), (7, 2, "create", 0, 10), (8, 2, "renew", 50, 10), (9, 2, "release", 51, None), (10, 2, "renew", 52, 10), (11, 3, "create", 0, 0)]
    got = lease.folded(spark.createDataFrame(events, EVENTS)).orderBy("seq").collect()
    assert [(r["ok"], r["expire_at_ms"]) for r in got] == [(False, None), (True, 100), (True, 199), (True, 199), (False, None), (False, None), (True, 10), (True, 60), (True, None), (False, None), (False, None)]


def test_lease_keys(spark):
    keys = spark.createDataFrame([(1, "foo"), (1, "bar"), (1, "foo"), (2, "baz")], "lease_id long, key string")
    index = lease.indexed(keys)
    assert {r["lease_id"]: r["keys"] for r in index.collect()} == {1: ["bar", "foo"], 2: ["baz"]}
    assert lease.restored_index(index).count() == 3
    leases = spark.createDataFrame([(1, 100, 100), (2, 900, 100), (3, 900, 100)], "lease_id long, expire_at_ms long, ttl_ms long")
    out = lease.exported(leases, keys, 500)
    assert [r["lease_id"] for r in out.collect()] == [2]
    alive, left, next_id = lease.restored(lease.exported(leases, keys, 0), 500)
    assert alive.count() == 1 and [r["key"] for r in left.collect()] == ["baz"] and next_id.first()[0] == 3
    log = log_of(spark, (1, "SET", "foo", "1"), (2, "SET", "baz", "2"))
    assert kv(lease.cascade(log, leases, keys, 500)) == {"foo": None, "bar": None, "baz": "2"}


def test_segments(spark):
    rows = spark.createDataFrame([(i, 100) for i in range(1, 101)] + [(101, 5000), (102, 10)], "seq long, bytes long")
    got = segments.rotated(rows, 512).orderBy("segment_id").collect()
    assert [r["n"] for r in got] == [5] * 20 + [1, 1] and got[-2]["bytes"] == 5000
    df = segments.rotated(rows, 512)
    assert segments.pruned(df, 25).agg(F.min("first_seq")).first()[0] == 26
    assert segments.collected(df, 10**9).count() == 1
    due = lambda n, last, **k: segments.snapshot_due(spark.range(n).select((F.col("id") + 1).alias("seq")), last, 10, **k).first()["due"]
    assert [due(0, 0), due(9, 0), due(10, 0), due(15, 10), due(15, 10, forced=True), due(0, 0, forced=True)] == [False, False, True, False, True, False]


def test_rotation_follows_a_fold(spark, monkeypatch):
    rng = random.Random(9)
    for bits, n in ((16, 300), (5, 300), (2, 50)):
        monkeypatch.setattr(segments, "STRETCH_BITS", bits)
        rows, seq = [], 0
        for _ in range(n):
            seq += rng.choice((1, 1, 1, 5))
            rows.append((seq, rng.choice((0, 1, 40, 100, 512, 513, 5000))))
        want: list[list[int]] = []
        for s, b in rows:
            if not want or want[-1][4] + b > 512:
                want.append([len(want) + 1, s, s, 0, 0])
            want[-1][2:] = [s, want[-1][3] + 1, want[-1][4] + b]
        got = segments.rotated(spark.createDataFrame(rows, "seq long, bytes long").repartition(3), 512).orderBy("segment_id").collect()
        assert [list(r) for r in got] == want


def test_gaps(spark):
    rows = spark.createDataFrame([(i,) for i in (1, 2, 5, 65535, 65536, 131072, 131074)], "seq long")
    assert sorted(tuple(r) for r in logs.gaps(rows).collect()) == [(2, 5), (5, 65535), (65536, 131072), (131072, 131074)]


def test_snapshots(spark, tmp_path):
    log = log_of(spark, (1000, "SET", "alpha", "111"), (2000, "SET", "beta", "222"), (3000, "DEL", "alpha", None), (4000, "SET", "c", "3"))
    leases = spark.createDataFrame([(1, 5000, 5000)], "lease_id long, expire_at_ms long, ttl_ms long")
    keys = spark.createDataFrame([(1, "alpha"), (1, "beta")], "lease_id long, key string")
    at = snapshot.write(str(tmp_path), log, 2, leases=leases, lease_keys=keys)
    assert kv(snapshot.load(spark, at, log)) == kv(state.latest(log))
    assert kv(snapshot.load(spark, at, log.where("false"))) == {"alpha": "111", "beta": "222"}
    assert snapshot.load_leases(spark, at, 0)[1].count() == 2 and snapshot.load_leases(spark, at, 5000)[1].count() == 0
    assert snapshot.load(spark, str(tmp_path / "missing"), log) is None


def test_replicas(spark):
    log = log_of(spark, *[(i * 37 % 101, "SET", f"k{i % 13}", str(i)) for i in range(1, 101)])
    assert kv(replica.merged(log.where("seq <= 70"), log.where("seq > 30"))) == kv(state.latest(log))
    batches = replica.wal_batches(log, 10, 40).orderBy("batch").collect()
    assert [(b["base_revision"], b["last_revision"], b["n"]) for b in batches] == [(10, 50, 40), (50, 90, 40), (90, 100, 10)]
    chunks = replica.snapshot_chunks(spark.createDataFrame([(150_000,)], "total_bytes long")).collect()
    assert [r["length"] for r in chunks] == [65536, 65536, 150_000 - 131072]
    assert replica.snapshot_chunks(spark.createDataFrame([(0,)], "total_bytes long")).count() == 0


def test_watches(spark):
    log = log_of(spark, (1000, "SET", "user:1", "A"), (900, "SET", "user:1", "stale"), (1500, "SET", "order:1", "X"), (2000, "DEL", "user:1", None))
    got = watch.watch_changes(log, "user:").orderBy("seq").collect()
    assert [(r["kind"], r["value"]) for r in got] == [("Set", "A"), ("Delete", None)]
    watches = spark.createDataFrame([(1, "user:"), (2, "u"), (3, "user:1234"), (4, "")], "watch_id long, prefix string")
    got = watch.fan_out(log, watches).groupBy("watch_id").count().collect()
    assert {r[0]: r[1] for r in got} == {1: 3, 2: 3}


def test_discovery(spark):
    good = '{"serviceName":"s","instanceId":"1","address":{"host":"h","port":1},"metadata":{"a":"b"},"leaseId":7}'
    values = [good, '{"serviceName":"s"}', '{"serviceName":"s","address":{"port":"x"}}', good[:30], "null"]
    log = log_of(spark, *[(i, "SET", f"services/s/instances/{i}", v) for i, v in enumerate(values)], (9, "SET", "services/s2/instances/0", good))
    assert [r["key"] for r in discovery.instances(log, "s").collect()] == ["services/s/instances/0", "services/s/instances/1"]
    rows = spark.createDataFrame([("s", "i", "h", 1, None, 1), (" ", "i", "h", 1, None, 1), ("s", "", "h", 1, None, 1)], "service string, instance string, host string, port int, metadata map<string,string>, lease_id long")
    assert discovery.registered(rows, 1).count() == 1
    with pytest.raises(ValueError):
        discovery.registered(rows, 0)
