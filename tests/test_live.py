"""Streams against batches, and the store's calls."""

import pytest

from tideline.operators import lease, state
from tideline.plans.catalogue import _mixed_events
from tideline.service import Store
from tideline.sources import log as logs
from tideline.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    log = logs.change_log(spark, SF)
    for i in range(4):
        log.where(f"seq between {250 * i + 1} and {250 * i + 250}").coalesce(1).write.mode("append").parquet(path)
    return path


def test_watch(spark, folder, tmp_path):
    got = []
    q = live.watch(live.log_stream(spark, folder, 1), "users/1", lambda df, _: got.extend(tuple(r) for r in df.collect()), str(tmp_path), from_seq=100)
    q.awaitTermination(120)
    assert sorted(got, key=str) == sorted(map(tuple, logs.replay(logs.change_log(spark, SF), 100, "users/1").collect()), key=str)
    with pytest.raises(ValueError):
        live.watch(live.log_stream(spark, folder), "", print, str(tmp_path))


def _run(spark, df, name, path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name)


def test_last_writer(spark, folder, tmp_path):
    live.configure(spark)
    got = _run(spark, live.changed(live.log_stream(spark, folder, 2)), "changed", str(tmp_path))
    last = {}
    for r in sorted(got.collect(), key=lambda r: (r["phys_ms"], r["logical"], r["node_id"])):
        last[r["key"]] = r["value"]
    assert last == {r["key"]: r["value"] for r in state.latest(logs.change_log(spark, SF)).collect()}


def test_lease_timers(spark, tmp_path):
    live.configure(spark)
    schema = "seq long, lease_id long, kind string, now_ms long, ttl_ms long"
    src = str(tmp_path / "in")
    rows = [[(1, 1, "create", 1000, 100), (2, 2, "create", 1000, 100), (3, 3, "create", 1000, 100)], [(4, 1, "renew", 1090, 500), (5, 3, "revoke", 1095, None)], [(6, 9, "create", 1200, 9000)], [(7, 9, "keepalive", 3000, None)], [(8, 9, "keepalive", 3001, None)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = _run(spark, live.expiries(stream), "expired", str(tmp_path / "cp"))
    assert {(r["lease_id"], r["expire_at_ms"]) for r in got.collect()} == {(2, 1100), (1, 1590)}


def test_store(spark, tmp_path):
    now = [1000]
    s = Store(spark, str(tmp_path), clock=lambda: now[0])
    assert s.get("a") is None
    r = s.set("a", "1")
    assert s.get("a") == "1" and s.compare_and_set("a", r + 5, "x") is None
    r2 = s.compare_and_set("a", r, "2")
    assert r2 > r and s.get("a") == "2" and s.compare_and_set("new", 0, "n") is not None
    assert s.compare_and_delete("a", r) is None and s.compare_and_delete("a", r2) and s.get("a") is None
    s.ensure("many", "v", 5)
    assert s.by_prefix("many/").count() == 5
    lease_id = s.create_lease(100)
    assert s.put_ephemeral(lease_id, "eph", "x") and s.get("eph") == "x"
    now[0] += 50
    assert s.keep_alive(lease_id) and s.collect_expired() == 0
    now[0] += 100
    assert s.collect_expired() == 1 and s.get("eph") is None and not s.put_ephemeral(lease_id, "eph", "y")
    assert not s.keep_alive(lease_id)
    with pytest.raises(ValueError):
        s.create_lease(0)
    l2 = s.create_lease(1000)
    s.attach(l2, "k1")
    s.attach(l2, "k2")
    s.detach(l2, "k1")
    assert s.renew(l2, 2000) and not s.renew(77, 5) and s.keys_of(l2) == ["k2"] and s.keys_of(l2) == []
    key, revision, _ = s.register("svc", "h", 80, 1000, "i1", {"z": "1"})
    assert [r["instance"] for r in s.instances("svc").collect()] == ["i1"]
    assert s.unregister(key, revision) and s.instances("svc").count() == 0
    assert [r["kind"] for r in s.watch("a").collect()] == ["Set", "Set", "Delete"]
    again = Store(spark, str(tmp_path), clock=lambda: now[0])
    assert again.set("b", "1") == s.seq + 1


def test_lease_fold_matches_a_loop(spark):
    rows = lease.folded(_mixed_events(logs.change_log(spark, SF))).collect()
    assert len(rows) == 1000 and any(r["ok"] for r in rows)


def test_watches_come_and_go(spark):
    log = logs.change_log(spark, SF)
    watches, told = live.Watches(), []
    a, b = watches.subscribe("users/1", lambda df: told.extend(r["seq"] for r in df.collect())), watches.subscribe("users/", capacity=5)
    watches.publish(log.where("seq <= 500"))
    assert watches.unsubscribe(a) and not watches.unsubscribe(a)
    watches.publish(log.where("seq > 500"), 1)
    assert told == [r["seq"] for r in logs.replay(log, 0, "users/1").where("seq <= 500").orderBy("seq").collect()]
    assert [r["seq"] for r in watches.take(b)] == list(range(996, 1001)) and watches.take(b) == []
    with pytest.raises(ValueError):
        watches.subscribe("")


def test_reopened_store_goes_on(spark, tmp_path):
    now = [5000]
    s = Store(spark, str(tmp_path), clock=lambda: now[0])
    s.set("a", "old")
    now[0] = 4999
    again = Store(spark, str(tmp_path), clock=lambda: now[0])
    again.set("a", "new")
    assert again.get("a") == "new" and len(list((tmp_path / "log").glob("*.parquet"))) <= 3
    i = again.create_lease(100)
    for k in range(3):
        again.attach(i, f"k{k}")
    now[0] += 500
    assert again.collect_expired() == 1 and again.lease_keys().count() == 0
    rows = again.log().where("op = 'DEL'").collect()
    assert len(rows) == 3 and len({(r["phys_ms"], r["logical"]) for r in rows}) == 3 and again.set("z", "1") == max(r["seq"] for r in rows) + 1


def test_puts_as_of_the_lease_in_force(spark):
    events = spark.createDataFrame([(1, 1, "create", 0, 100), (5, 1, "create", 500, 100), (7, 1, "release", 550, None)], "seq long, lease_id long, kind string, now_ms long, ttl_ms long")
    puts = spark.createDataFrame([(2, 1, "k", "in", 50), (3, 1, "k", "gap", 300), (6, 1, "k", "again", 540), (8, 1, "k", "late", 560), (9, 2, "k", "none", 1)], "seq long, lease_id long, key string, value string, now_ms long")
    assert sorted(r["value"] for r in lease.put_ephemeral(puts, events).collect()) == ["again", "in"]
    refused = spark.createDataFrame([(1, 1, "create", 0, 100), (2, 1, "keepalive", 200, 100)], "seq long, lease_id long, kind string, now_ms long, ttl_ms long")
    assert lease.latest_leases(refused).count() == 0  # a keepalive after expiry revives nothing


def test_saved_and_released(spark):
    from pathlib import Path

    from tideline.sources import shared

    df = shared.saved(spark.range(100))
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    assert df.count() == 100 and Path(file.removeprefix("file:")).exists()
    shared.released(df)
    assert not Path(file.removeprefix("file:")).exists()
