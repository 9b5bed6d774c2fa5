"""The store end to end, isolation anomalies, subscriptions."""

import json
import random
import threading
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tesselkv import errors as E
from tesselkv.plans.levels import LevelConfig
from tesselkv.store import Config, Entry, Store
from tesselkv.streaming.subscriptions import Registry, StateTable, Subscription, matching, parse_ignore


@pytest.fixture
def store(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", Config(value_threshold=20), now=lambda: 1000) as s:
        yield s


def get(t, key):
    try:
        return t.get(key).value
    except E.KeyNotFound:
        return None


def test_smoke(store):
    assert store.update(lambda t: t.set(b"a", b"1")) == 1
    assert store.get(b"a").value == b"1" and store.get(b"a", 0) is None
    assert store.update(lambda t: None) is None


def test_read_your_writes_and_ttl(store):
    t = store.txn()
    t.set(b"a", b"1")
    assert get(t, b"a") == b"1" and t.reads == set()
    t.delete(b"a")
    assert get(t, b"a") is None
    t.set_entry(Entry(b"b", b"x").with_ttl(0, 1000))
    assert get(t, b"b") is None
    t.set_entry(Entry(b"c", b"x", user_meta=7).with_ttl(1, 1000))
    assert t.get(b"c").user_meta == 7
    t.commit()
    assert [bytes(r.user_key) for r in store.scan().collect()] == [b"c"]
    with pytest.raises(E.DiscardedTxn):
        t.get(b"c")


def test_write_errors(store):
    t = store.txn()
    for key, error in ((b"", E.EmptyKey), (b"!sys!x", E.InvalidKey), (b"k" * 65_001, E.InvalidKey)):
        with pytest.raises(error):
            t.set(key, b"")
    with pytest.raises(E.ReadOnlyTxn):
        store.txn(update=False).set(b"a", b"")
    with pytest.raises(E.BadConfig):
        Config(vlog_file_size=1).checked()
    with pytest.raises(E.InvalidEncryptionKey):
        Config(encryption_key=b"x").checked()


def test_ingest_refuses_what_a_transaction_does(spark, tmp_path):
    banned, allowed = (7).to_bytes(8, "big") + b"x", (8).to_bytes(8, "big") + b"x"
    with Store(spark, f"file://{tmp_path}/s", Config(namespace_offset=0), now=lambda: 1000) as s:
        s.ban_namespace(7)
        s.config = replace(s.config, vlog_file_size=24)  # Config itself would ask for a MiB
        wrong = [(None, b"", E.EmptyKey), (b"", b"", E.EmptyKey), (b"!sys!x", b"", E.InvalidKey), (b"k" * 65_001, b"", E.InvalidKey), (b"k", b"v" * 25, E.ValueLogSize), (banned, b"", E.BannedKey)]
        for key, value, error in wrong:
            with pytest.raises(error):
                s.ingest(spark.createDataFrame([(bytearray(b"a"), bytearray(b"1")), (key if key is None else bytearray(key), bytearray(value))], "user_key binary, value binary"))
        assert s.files.names("log") == [] == s.state["log"] and s.scan().count() == 0
        s.ingest(spark.createDataFrame([(bytearray(k), bytearray(b"v" * 24)) for k in (b"k" * 65_000, allowed, b"!sys")], "user_key binary, value binary"))
        assert s.scan().count() == 3


def test_too_big(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", Config(levels=LevelConfig(memtable_size=10_000), value_threshold=100)) as s:
        t = s.txn()
        with pytest.raises(E.TxnTooBig):
            for i in range(1000):
                t.set(b"k%d" % i, b"v")


def test_anomalies(store):
    store.update(lambda t: (t.set(b"x", b"50"), t.set(b"y", b"50")))
    # lost update
    a, b = store.txn(), store.txn()
    get(a, b"x"), get(b, b"x")
    a.set(b"x", b"1")
    b.set(b"x", b"2")
    a.commit()
    with pytest.raises(E.Conflict):
        b.commit()
    # dirty, non-repeatable and skewed reads
    r, w = store.txn(), store.txn()
    assert get(r, b"x") == b"1"
    w.set(b"x", b"25")
    w.set(b"y", b"75")
    assert get(r, b"x") == b"1"
    w.commit()
    assert (get(r, b"x"), get(r, b"y")) == (b"1", b"50")
    # phantom: both scans of a snapshot are equal
    before = r.scan().count()
    store.update(lambda t: t.set(b"z", b""))
    assert r.scan().count() == before
    r.discard()
    # write skew
    a, b = store.txn(), store.txn()
    for t in (a, b):
        get(t, b"x"), get(t, b"y")
    a.set(b"x", b"0")
    b.set(b"y", b"0")
    a.commit()
    with pytest.raises(E.Conflict):
        b.commit()
    # blind writes do not conflict; the later commit stands
    a, b = store.txn(), store.txn()
    a.set(b"x", b"a")
    b.set(b"x", b"b")
    a.commit()
    b.commit()
    assert store.get(b"x").value == b"b"
    # a read that found nothing is a read; a range is not tracked
    a = store.txn()
    assert get(a, b"new") is None
    store.update(lambda t: t.set(b"new", b""))
    a.set(b"q", b"")
    with pytest.raises(E.Conflict):
        a.commit()


@pytest.mark.parametrize("flushed", [False, True])
def test_ingest_conflicts_with_open_reads(store, flushed):
    store.update(lambda t: (t.set(b"x", b"1"), t.set(b"y", b"1")))
    hit, new, other, blind = (store.txn() for _ in range(4))
    assert (get(hit, b"x"), get(new, b"new"), get(other, b"y")) == (b"1", None, b"1")
    for t in (hit, new, other, blind):
        t.set(b"x" if t is blind else b"q", b"2")
    store.ingest(store.spark.createDataFrame([(bytearray(k), bytearray(b"9")) for k in (b"x", b"new")], "user_key binary, value binary"))
    if flushed:
        store.flush()
        store.truncate_log()
    for t in (hit, new):
        with pytest.raises(E.Conflict):
            t.commit()
    other.commit()
    blind.commit()
    store.update(lambda t: t.set(b"x", get(t, b"x") + b"3"))  # reads what was ingested and after
    assert store.get(b"x").value == b"23"
    store.flush()
    store.truncate_log()
    assert store.oracle.ingested == {} and store.files.names("log") == []


def test_ingest_conflicts_with_managed_reads(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", Config(managed_txns=True)) as s:
        s.ingest(spark.createDataFrame([(bytearray(b"x"), bytearray(b"9"))], "user_key binary, value binary"))
        s.flush()
        s.truncate_log()
        t = s.txn_at(0)
        assert get(t, b"x") is None
        t.set(b"x", b"1")
        with pytest.raises(E.Conflict):
            t.commit(at=40)


def test_against_a_model(spark, tmp_path):
    r = random.Random(11)
    model: dict[bytes, list] = {}
    root = f"file://{tmp_path}/s"
    s = Store(spark, root, Config(value_threshold=8, num_versions_to_keep=100), now=lambda: 1000)
    for step in range(14):
        t, ops = s.txn(), []
        for _ in range(4):
            k, v = b"k%d" % r.randrange(6), b"v" * r.randrange(1, 15)
            if r.random() < 0.25:
                t.delete(k)
                v = None
            else:
                t.set(k, v)
            ops.append((k, v))
        ts = t.commit()
        for k, v in dict(ops).items():
            model.setdefault(k, []).append((ts, v))
        if step in (4, 9):
            s.flush()
        if step == 10:
            s.compact(force=True)
        if step == 11:
            s.close()
            s = Store(spark, root, Config(value_threshold=8, num_versions_to_keep=100), now=lambda: 1000)
    for at in (3, 9, 14):
        want = {k: x[-1] for k, vs in model.items() if (x := [v for ts, v in vs if ts <= at]) and x[-1] is not None}
        if at >= 11:  # deletes were compacted away below that
            assert {bytes(x.user_key): bytes(x.value) for x in s.scan(read_ts=at).collect()} == want
    assert s.check() == []
    last = {k: vs[-1][1] for k, vs in model.items() if vs[-1][1] is not None}
    assert {bytes(x.user_key): bytes(x.value) for x in s.scan().collect()} == last
    for k in model:
        assert (s.get(k) and s.get(k).value) == last.get(k)
    s.close()


def test_values_and_prefixes(store):
    store.ingest(store.spark.createDataFrame([(bytearray(b"a%03d" % i), bytearray(b"v" * i)) for i in range(50)], "user_key binary, value binary"))
    store.update(lambda t: t.set(b"b", b"w" * 30))
    store.flush()
    assert store.state["vlog"] and store.get(b"a049").value == b"v" * 49
    store.drop_prefix(b"a")
    assert [bytes(x.user_key) for x in store.scan().collect()] == [b"b"]
    assert sum(store.state["discard"].values()) > 0
    assert store.reclaim_values() == 1 and store.get(b"b").value == b"w" * 30
    assert store.sizes()["tables"] > 0 and store.table_info().count() == 1


@pytest.mark.parametrize("old", [False, True])
def test_many_value_log_files_of_a_flush(spark, tmp_path, old):
    def rows(letter, n):
        return spark.range(n).select(F.format_string(letter + "%05d", "id").cast("binary").alias("user_key"), F.format_string(letter + "%023d", "id").cast("binary").alias("value"))

    with Store(spark, f"file://{tmp_path}/s", Config(value_threshold=20), now=lambda: 1000) as s:
        s.config = replace(s.config, vlog_file_size=24)  # a file a value; Config itself would ask for a MiB
        s.ingest(rows("a", 10_003))
        s.flush()
        if old:  # a manifest that doesn't have the next id
            s.state.pop("next_fid", None)
        s.ingest(rows("b", 5))
        s.flush()
        got = {bytes(r.user_key): bytes(r.value) for r in s.scan().collect()}
        assert s.scan().count() == len(got) == 10_008
        assert got[b"a10001"] == b"a%023d" % 10_001 and got[b"b00001"] == b"b%023d" % 1
        assert s.reclaim_values() == 10_008


def test_lock_read_only_and_namespaces(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    s = Store(spark, root, Config(namespace_offset=0))
    key = (7).to_bytes(8, "big") + b"x"
    s.update(lambda t: t.set(key, b"1"))
    s.ban_namespace(7)
    with pytest.raises(E.BannedKey):
        s.txn().get(key)
    with pytest.raises(E.StoreLocked):
        Store(spark, root)
    s.close()
    with pytest.raises(E.StoreClosed):
        s.scan()
    with Store(spark, root, Config(read_only=True)) as a, Store(spark, root, Config(read_only=True)) as b:
        assert a.get(key).value == b.get(key).value == b"1"
        with pytest.raises(E.ReadOnlyTxn):
            a.update(lambda t: t.set(b"k", b""))
        with pytest.raises(E.StoreLocked):
            Store(spark, root)


def test_encryption(spark, tmp_path):
    root, clock = f"file://{tmp_path}/s", [1000]
    with Store(spark, root, Config(encryption_key=b"k" * 32, key_rotation=10, value_threshold=20), now=lambda: clock[0]) as s:
        s.update(lambda t: t.set(b"a", b"secret-value"))
        clock[0] += 10
        s.update(lambda t: t.set(b"b", b"secret" * 10))
        assert len(s.keys.keys) == 2
        s.flush()
        assert (s.get(b"a").value, s.get(b"b").value) == (b"secret-value", b"secret" * 10)
    assert not any(b"secret" in p.read_bytes() for p in (tmp_path / "s").rglob("*") if p.is_file())
    for key in (b"x" * 32, b""):
        with pytest.raises(E.EncryptionKeyMismatch):
            Store(spark, root, Config(encryption_key=key))
    with Store(spark, root, Config(encryption_key=b"k" * 32)) as s:
        assert s.get(b"b").value == b"secret" * 10
        with pytest.raises(E.InvalidDataKeyID):
            s.keys.data_key(9)


def test_left_overs_and_missing_files(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    with Store(spark, root) as s:
        s.update(lambda t: t.set(b"a", b"1"))
        s.flush()
        path = s.state["tables"][0]["path"]
    (tmp_path / "s/sst/000000000099-1").mkdir()
    with Store(spark, root):
        assert not (tmp_path / "s/sst/000000000099-1").exists()
    (tmp_path / "s" / path).unlink()
    with pytest.raises(E.ManifestError):
        Store(spark, root)


def test_managed(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", Config(managed_txns=True)) as s:
        t = s.txn_at(0)
        t.set(b"a", b"1")
        assert t.commit(at=40) == 40 and s.get(b"a", 39) is None and s.get(b"a", 40).version == 40
        assert s.update(lambda t: t.set(b"a", b"2")) == 41


def test_ignore_ranges():
    assert parse_ignore("1") == [False, True] and parse_ignore("0") == [True] and parse_ignore("") == []
    assert parse_ignore("0 , 3 - 5 ,7 ") == [True, False, False, True, True, True, False, True]
    for bad in ("x", "5-3", "1-", "-1"):
        with pytest.raises(E.BadIgnoreRange):
            parse_ignore(bad)


def test_matching(spark):
    subs = [Subscription(i, p) for i, p in ((1, b"hello"), (3, b"hello"), (20, b"hel"), (20, b"he"), (10, b""))] + [Subscription(5, b"h?l", "1")]
    want = {b"A": [10], b"hel": [5, 10, 20], b"hxl": [5, 10], b"hl": [10], b"ha": [10], b"hello!": [1, 3, 5, 10, 20], None: []}
    df = spark.createDataFrame([(k and bytearray(k),) for k in want], "user_key binary")
    got = {r.user_key and bytes(r.user_key): r.ids for r in df.select("user_key", matching(subs).alias("ids")).collect()}
    assert got == want


def test_subscribe(store, tmp_path):
    store.update(lambda t: (t.set(b"ab", b"1"), t.set(b"b", b"2")))
    got = []

    def take(batch, _):
        got.extend((r.subscription, bytes(r.user_key), bytes(r.value)) for r in batch.collect())

    def run(callback):
        q = store.subscribe([Subscription(1, b"a")], callback, str(tmp_path / "c"), once=True)
        q.awaitTermination()

    run(take)
    store.update(lambda t: t.set(b"ac", b"3"))
    run(take)
    assert got == [(1, b"ab", b"1"), (1, b"ac", b"3")]
    store.update(lambda t: t.set(b"ad", b"4"))
    with pytest.raises(Exception, match="no more"):
        run(lambda *_: (_ for _ in ()).throw(RuntimeError("no more")))


def test_state_table_of_a_feed(spark, tmp_path):
    s = StateTable(f"file://{tmp_path}/t", "table_id", "seq", "op")
    kind = "table_id int, seq bigint, op string, level int"
    s.apply(spark.createDataFrame([(1, 5, "CREATE", 2), (2, 2, "0", 1)], kind), 0)
    s.apply(spark.createDataFrame([(1, 4, "1", None), (2, 3, "delete", None)], kind), 1)
    s.apply(spark.createDataFrame([(2, 9, "0", 9)], kind), 1)  # a batch that comes again
    assert [(r.table_id, r.level) for r in s.read(spark).collect()] == [(1, 2)]


def test_flush_when_due(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", Config(log_commits=2)) as s:
        for i in range(3):
            s.update(lambda t, i=i: t.set(b"k%d" % i, b"v"))
        assert len(s.state["tables"]) == 1 and len(s.state["log"]) == 1
        assert s.scan().count() == 3


def test_managed_reads_keep_their_versions(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", Config(managed_txns=True), now=lambda: 1000) as s:
        for ts in (5, 10):
            t = s.txn_at(ts)
            t.set(b"k", str(ts).encode())
            t.commit(ts)
        s.flush()
        s.compact(force=True)
        assert s.txn_at(7).get(b"k").value == b"5"
        s.set_discard_ts(10)
        s.compact(force=True)
        with pytest.raises(E.KeyNotFound):
            s.txn_at(7).get(b"k")
        assert s.txn_at(10).get(b"k").value == b"10"


def test_a_held_scan_outlives_a_compaction(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", Config(file_retention=0), now=lambda: 1000) as s:
        s.ingest(spark.createDataFrame([(bytearray(b"k%d" % i), bytearray(b"v")) for i in range(20)], "user_key binary, value binary"))
        s.flush()
        t = s.txn(False)
        held = t.scan()
        s.compact(force=True)
        assert held.count() == 20 and s.state["retired"]
        t.discard()
        assert s.remove_retired() and not s.state["retired"] and s.scan().count() == 20


def test_a_commit_in_flight_is_not_read(store):
    ts = store.oracle.commit_ts(0, (), [b"k"])
    t = store.txn()
    assert t.read_ts < ts
    started, got = threading.Event(), []

    def other():
        started.set()
        got.append(store.oracle.read_ts())

    thread = threading.Thread(target=other)
    thread.start()
    started.wait()
    time.sleep(0.2)
    assert not got  # waits for this thread's commit
    store.oracle.done_commit(ts)
    thread.join(10)
    assert got == [ts]


def test_a_lock_of_a_dead_process_is_taken_over(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    s = Store(spark, root, now=lambda: 1000)
    s.update(lambda t: t.set(b"k", b"1"))
    with pytest.raises(E.StoreLocked):
        Store(spark, root)
    s.lease._ended.set()  # as if the process had died: nobody renews, and its number is free
    dead = dict(s.lease.token, pid=2**22 + 1)
    s.files.delete("LOCK")
    s.files.create_new("LOCK", json.dumps(dead).encode())
    with Store(spark, root, now=lambda: 1000) as other:
        assert other.get(b"k").value == b"1"
        with pytest.raises(E.StoreLocked):
            s.update(lambda t: t.set(b"k", b"2"))
    elsewhere = dict(dead, host="another machine")
    s.files.create_new("LOCK", json.dumps(elsewhere).encode())
    with pytest.raises(E.StoreLocked):
        Store(spark, root)
    s.files.touch("LOCK", time.time() - 100)
    Store(spark, root).close()


def test_scans_of_a_transaction_see_its_writes_and_conflict(store):
    store.update(lambda t: [t.set(b"a%d" % i, b"old") for i in range(4)])
    t = store.txn()
    t.set(b"a1", b"new")
    t.set(b"a9", b"new")
    t.delete(b"a2")
    got = [(bytes(r.user_key), bytes(r.value)) for r in t.scan((b"a", b"b")).collect()]
    assert got == [(b"a0", b"old"), (b"a1", b"new"), (b"a3", b"old"), (b"a9", b"new")]
    store.update(lambda u: u.set(b"c", b"outside"))
    u = store.txn()
    u.scan((b"a", b"b"))
    u.set(b"x", b"1")
    assert t.commit()
    with pytest.raises(E.Conflict):
        u.commit()
    w = store.txn()
    w.scan((b"a", b"b"))
    w.set(b"x", b"2")
    store.ingest(store.spark.createDataFrame([(bytearray(b"a7"), bytearray(b"v"))], "user_key binary, value binary"))
    with pytest.raises(E.Conflict):
        w.commit()
    assert store.beside(b"a1") == (b"a0", b"a2", b"x" if store.get(b"x") else b"c")


def test_reads_leave_out_tables_and_value_files(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", Config(value_threshold=50), now=lambda: 1000) as s:
        for letter in "abc":
            s.ingest(spark.createDataFrame([(bytearray(f"{letter}{i}".encode()), bytearray(letter.encode() * 100)) for i in range(5)], "user_key binary, value binary"))
            s.flush()
        assert len(s.state["vlog"]) == 3
        s.metrics.clear()
        assert s.get(b"b3").value == b"b" * 100
        assert (s.metrics["tables_read"], s.metrics["tables_pruned"], s.metrics["value_files_read"]) == (1, 2, 1)
        s.metrics.clear()
        got = s.scan(within=(b"b", b"d")).collect()
        assert [bytes(r.user_key)[:1] for r in got] == [b"b"] * 5 + [b"c"] * 5 and all(len(r.value) == 100 for r in got)
        assert (s.metrics["tables_read"], s.metrics["tables_pruned"]) == (2, 1)


def test_large_flush_hot_key_and_cuts(spark, tmp_path):
    levels = LevelConfig(memtable_size=1 << 20)
    with Store(spark, f"file://{tmp_path}/s", Config(managed_txns=True, levels=levels, output_rows=500, log_commits=100, value_threshold=1000), now=lambda: 1000) as s:
        rows = spark.range(60_000).select(F.encode(F.concat(F.lit("k"), F.sha2(F.col("id").cast("string"), 512)), "UTF-8").alias("user_key"), F.encode(F.sha2(F.col("id").cast("string"), 512), "UTF-8").alias("value"))
        s.ingest(rows)
        assert len(s.state["tables"]) > 3  # a flush makes a table of each memtable's bytes
        assert s.scan().count() == 60_000
        for ts in range(100, 140):
            t = s.txn_at(ts)
            t.set(b"hot", b"x" * 40)
            t.commit(ts)
        s.flush()
        s.compact(force=True)
        hot = [t for t in s.state["tables"] if t["smallest"] <= b"hot".hex() <= t["biggest"]]
        assert hot and s.check() == []
        assert {t.version for t in s.records(b"hot").collect()} == set(range(100, 140))
        assert s.write_amplification() > 1


def test_stale_tables_of_the_last_level(spark, tmp_path, monkeypatch):
    from tesselkv.plans import levels as L

    clock = [1000]
    with Store(spark, f"file://{tmp_path}/s", now=lambda: clock[0]) as s:
        for v in (b"1", b"2"):
            s.update(lambda t, v=v: [t.set_entry(Entry(b"k%d" % i, v, meta=4)) for i in range(30)])  # discards earlier ones
            s.flush()
        s.compact(force=True)
        assert sum(t["stale"] for t in s.state["tables"]) == 30 * (3 + 1 + 12) - 10
        assert s.maintain() == 0
        clock[0] += 7200
        monkeypatch.setattr(L, "STALE_BYTES", 100)
        made = s.compact()
        assert made and made[0]["level"] == s.config.levels.levels - 1 and s.scan().count() == 30


def test_manifest_differences(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    with Store(spark, root, now=lambda: 1000) as s:
        for i in range(70):
            s.ban_namespace(i)
        s.update(lambda t: t.set(b"k", b"v"))
        names = s.files.names("manifest")
        state = s.state
    assert any(n.endswith(".delta.json") for n in names)
    with Store(spark, root, now=lambda: 1000) as s:
        assert s.state["banned"] == list(range(70)) and s.state["log"] == state["log"] and s.get(b"k").value == b"v"


def test_plans_do_not_show_keys(spark, tmp_path, capsys):
    key = b"0123456789abcdef"
    with Store(spark, f"file://{tmp_path}/s", Config(encryption_key=key), now=lambda: 1000) as s:
        s.update(lambda t: t.set(b"k", b"v"))
        s.scan().explain(True)
        shown = capsys.readouterr().out
        data_key = s.keys.data_key(s.state["log"][0]["key"])
        assert data_key.hex().lower() not in shown.lower() and "redacted" in shown


def test_registered_at_run_time(store, tmp_path):
    registry, seen = Registry(), []
    store.update(lambda t: t.set(b"a1", b"v"))
    q = store.subscribe(registry, lambda b, i: seen.extend((r.subscription, bytes(r.user_key)) for r in b.collect()), f"file://{tmp_path}/c")
    try:
        q.processAllAvailable()
        number = registry.add(b"a")
        store.update(lambda t: t.set(b"a2", b"v"))
        q.processAllAvailable()
        registry.remove(number)
        store.update(lambda t: t.set(b"a3", b"v"))
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [(number, b"a2")]


def test_a_bad_entry_of_the_keyring_is_left_out(spark, tmp_path):
    clock, root = [1000], f"file://{tmp_path}/s"
    config = Config(encryption_key=b"0123456789abcdef", key_rotation=10)
    with Store(spark, root, config, now=lambda: clock[0]) as s:
        s.update(lambda t: t.set(b"a", b"1"))
        clock[0] += 20
        s.update(lambda t: t.set(b"b", b"2"))
        name = f"keys/{s.files.names('keys')[-1]}"
        held = json.loads(s.files.read(name))
        held["keys"][1]["created_at"] += 1
        s.files.delete(name)
        s.files.create(name, json.dumps(held).encode())
    with Store(spark, root, config, now=lambda: clock[0]) as s:
        assert s.keys.skipped == [held["keys"][1]["id"]] and len(s.keys.keys) == 1
        with pytest.raises(E.InvalidDataKeyID):
            s.get(b"b")
        assert s.keys.latest(clock[0]) > held["keys"][1]["id"]


def test_no_update_is_lost_between_threads(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", Config(file_retention=0), now=lambda: 1000) as s:
        done, failed = [], []

        def count(n):
            try:
                while n:
                    t = s.txn()
                    try:
                        t.set(b"n", b"%d" % (int(get(t, b"n") or 0) + 1))
                        done.append(t.commit())
                        n -= 1
                    except E.Conflict:
                        continue
                    finally:
                        t.discard()
            except Exception as e:
                failed.append(e)

        threads = [threading.Thread(target=count, args=(2,)) for _ in range(3)]
        for t in threads:
            t.start()
        while any(t.is_alive() for t in threads):
            s.ingest(spark.createDataFrame([(bytearray(b"other"), bytearray(b"v"))], "user_key binary, value binary"))
            s.flush()
            s.compact(force=True)
        for t in threads:
            t.join()
        assert not failed and s.get(b"n").value == b"6" and len(set(done)) == 6
        assert s.check() == [] and s.get(b"other").value == b"v"
