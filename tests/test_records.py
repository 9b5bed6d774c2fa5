"""Visibility, merges, retention and codecs, against models."""

import random

import pytest
from pyspark.sql import functions as F

from tesselkv import schema as S
from tesselkv.functions import codecs, sketches
from tesselkv.operators import integrity, merge, retention, snapshot, tables, txns, values


def kv(spark, rows):
    """Rows of (key, version, value, meta, expires_at)."""
    return spark.createDataFrame([(bytearray(k), v, None if x is None else bytearray(x), e, 0, m, None) for k, v, x, m, e in rows], S.KV)


VISIBLE = [
    (b"k1", 3, b"x", 64, 0), (b"k1", 7, b"x", 64, 0), (b"k2", 3, b"x", 64, 0), (b"k2", 7, b"", 1, 0), (b"k3", 3, b"x", 64, 0), (b"k3", 7, b"x", 64, 100), (b"k4", 3, b"x", 64, 0), (b"k4", 7, b"x", 64, 101),
    (b"k5", 3, b"x", 64, 0), (b"k5", 11, b"", 1, 0), (b"k6", 11, b"x", 64, 0), (b"k7", 3, b"", 1, 0), (b"k7", 7, b"x", 64, 0), (b"k8", 5, b"", 64, 0), (b"k9", 3, b"x", 64, 0), (b"k9", 7, b"", 0, 0),
]


def test_visibility_table(spark):
    got = {bytes(r.user_key): r.version for r in snapshot.snapshot(kv(spark, VISIBLE), 100, 10).collect()}
    assert got == {b"k1": 7, b"k4": 7, b"k5": 3, b"k7": 7, b"k8": 5, b"k9": 3}
    why = {bytes(r.user_key): r.why for r in snapshot.masked(kv(spark, VISIBLE), 100, 10).collect()}
    assert why == {b"k2": "deleted", b"k3": "expired"}


def test_order_of_iteration(spark):
    n = 1000
    rows = kv(spark, [(i.to_bytes(8, "big"), 1, i.to_bytes(8, "big"), 64, 0) for i in range(n)])
    forward = [bytes(r.user_key) for r in snapshot.scan(rows, 0).collect()]
    backward = [bytes(r.user_key) for r in snapshot.scan(rows, 0, reverse=True).collect()]
    assert forward == [i.to_bytes(8, "big") for i in range(n)] and backward == forward[::-1]
    head = [bytes(r.user_key) for r in snapshot.scan(rows, 0, limit=500).collect()]
    tail = [bytes(r.user_key) for r in snapshot.scan(rows, 0, reverse=True, limit=500).collect()]
    assert head + tail[::-1] == forward


def test_seek(spark):
    rows = kv(spark, [(i.to_bytes(8, "big"), 1, b"", 64, 0) for i in range(3, 1000)])
    for key, want in ((0, 3), (2, 3), (3, 3), (4, 4), (999, 999), (1000, None)):
        got = snapshot.seek(rows, key.to_bytes(8, "big")).collect()
        assert [int.from_bytes(bytes(r.user_key), "big") for r in got] == ([want] if want else [])


def test_newest_version_sorts_first(spark):
    got = snapshot.seek(kv(spark, [(b"a", 1, b"", 64, 0), (b"a", 2, b"", 64, 0), (b"b", 0, b"", 64, 0), (b"ab", 9, b"", 64, 0)]), b"a", 9).collect()
    assert [(bytes(r.user_key), r.version) for r in got] == [(b"a", 2), (b"a", 1), (b"ab", 9), (b"b", 0)]


def test_prefix_range(spark):
    keys = [b"", b"a", b"a\xff", b"a\xff\xff1", b"b", b"\xff", b"\xff\xff", b"\xff\xffz"]
    df = spark.createDataFrame([(bytearray(k),) for k in keys] + [(None,)], "user_key binary")
    for p in keys:
        got = {bytes(r.user_key) for r in df.where(S.in_prefix(p)).collect()}
        assert got == {k for k in keys if k.startswith(p)}


def test_neighbours(spark):
    df = spark.createDataFrame([(bytearray([i]),) for i in range(0, 200, 2)] + [(None,), (bytearray([0]),)], "user_key binary")
    got = {r.user_key[0]: (r.before and r.before[0], r.after and r.after[0]) for r in snapshot.neighbours(df).collect()}
    assert len(got) == 100 and got[0] == (None, 2) and got[198] == (196, None) and got[50] == (48, 52)


@pytest.mark.parametrize("heavy_rows", [20, 100_000])
def test_multi_get(spark, heavy_rows):
    r = random.Random(heavy_rows)
    rows = {(r.choice([b"hot", b"a", b"b", b"c"]), v): r.choice([0, 1, 64, 64, 64]) for v in range(1, 200)}
    data = [(k, v, b"" if m == 0 and v % 2 else b"x", m, r.choice([0, 0, 50, 200])) for (k, v), m in rows.items()]
    asks = [(i, r.choice([b"hot", b"hot", b"a", b"zz"]), r.randrange(0, 220)) for i in range(150)] + [(500, None, 3), (501, b"a", None)]
    got = snapshot.multi_get(spark.createDataFrame([(i, k and bytearray(k), t) for i, k, t in asks], "lookup_id bigint, user_key binary, read_ts bigint"), kv(spark, data), 100, heavy_rows)
    want = set()
    for i, k, t in asks:
        seen = [x for x in data if k and t is not None and x[0] == k and x[1] <= t and not (x[2] == b"" and x[3] == 0)]
        if seen:
            top = max(seen, key=lambda x: x[1])
            if not top[3] & 1 and not 0 < top[4] <= 100:
                want.add((i, top[1]))
    assert {(x.lookup_id, x.version) for x in got.collect()} == want


def test_merge_earlier_source_wins(spark):
    a, b = kv(spark, [(b"k", 1, b"a", 64, 0)]), kv(spark, [(b"k", 1, b"b", 64, 0), (b"k", 2, b"b", 64, 0)])
    got = sorted((r.version, bytes(r.value)) for r in merge.merge_sources([a, b]).collect())
    assert got == [(1, b"a"), (2, b"b")]
    assert sorted((r.version, bytes(r.value)) for r in merge.merge_sources([merge.merge_sources([b, a]), a]).collect()) == [(1, b"b"), (2, b"b")]
    assert [bytes(r.value) for r in merge.overlay(a, b.where("version = 2")).collect()] == [b"a"]


def keep_model(versions, now, discard_ts, keep, overlap):
    """The retention rule as a loop over the versions of one key, newest first."""
    out, n, skipping = set(), 0, False
    for v, meta, exp in versions:
        if skipping:
            continue
        gone = bool(meta & 1) or 0 < exp <= now
        if v <= discard_ts and not meta & 8:
            n += 1
            last = bool(meta & 4) or n == keep
            if gone or last:
                skipping = True
                if gone and not overlap:
                    continue
        out.add(v)
    return out


@pytest.mark.parametrize("heavy_rows", [15, 100_000])
@pytest.mark.parametrize(("keep", "overlap"), [(1, False), (3, True), (2, False)])
def test_retention(spark, heavy_rows, keep, overlap):
    r = random.Random(keep * heavy_rows)
    rows = [(bytes([k]), v, b"x", r.choice([0, 0, 0, 1, 4, 8, 9, 64]), r.choice([0, 0, 0, 50, 200])) for k in range(12) for v in r.sample(range(1, 60), 3 if k else 50)]
    got = retention.kept(retention.judged(kv(spark, rows), 100, 40, keep, overlap, heavy_rows=heavy_rows))
    want = set()
    for k in {x[0] for x in rows}:
        mine = sorted(((v, m, e) for kk, v, _, m, e in rows if kk == k), reverse=True)
        want |= {(k, v) for v in keep_model(mine, 100, 40, keep, overlap)}
    assert {(bytes(x.user_key), x.version) for x in got.collect()} == want


def test_retention_of_dropped_prefixes_and_nothing(spark):
    rows = kv(spark, [(b"ab", 1, b"x", 64, 0), (b"b", 1, b"x", 64, 0)])
    assert [bytes(r.user_key) for r in retention.kept(retention.judged(rows, 0, 9, drop_prefixes=[b"a"])).collect()] == [b"b"]
    assert retention.judged(rows.limit(0), 0, 9).collect() == []


def test_value_separation_round_trip(spark):
    rows = [(bytes([i]), 1, bytes([i]) * (i * 10), 64, 0) for i in range(1, 60)] + [(b"null", 1, None, 64, 0)]
    df = kv(spark, rows)
    apart, log = values.separated(df, 100, 1000, ["user_key", "version"])
    assert log.count() == 50 and apart.where(S.has(S.VALUE_POINTER)).count() == 50
    back = {bytes(r.user_key): r.value and bytes(r.value) for r in values.resolved(apart, log).collect()}
    assert back == {k: v for k, _, v, _, _ in rows}
    assert values.reclaim(log, apart.where("user_key < X'20'")).count() == 22
    spans = sorted((r.fid, r.offset, len(r.value)) for r in log.collect())
    assert all(a[0] < b[0] or a[1] + a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize(
    ("numbers", "wanted"),
    [
        ([2, 2, 3, 3, 4], {0: 2, 40: 2, 40.1: 3, 80: 3, 80.1: 4, 100: 4}),
        ([10] * 9000 + [25] * 900 + [33] * 90 + [47] * 9 + [500], {0: 10, 99: 25, 99.89: 33, 99.91: 47, 99.99: 47, 100: 502}),
        ([20] * 10, {50: 20}),
    ],
)
def test_histogram_percentiles(spark, numbers, wanted):
    h = sketches.log_histogram(spark.createDataFrame([(x,) for x in [*numbers, None]], "x int"), "x")
    got = {r.pct: round(r.value) for r in sketches.histogram_percentile(h, list(wanted)).collect()}
    assert got == {float(p): v for p, v in wanted.items()}


def test_bloom_hash_vectors():
    # Known hashes of the public Bloom hash.
    known = {"": 0xBC9F1D34, "a": 0x286E9DB0, "ab": 0x39ACA330, "abc": 0x855D012F, "abcd": 0xB9C83353, "abcde": 0x41D2C26D, "abcdefghi": 0xF065EC74, "你好": 0x06466387}
    assert {k: sketches.bloom_hash(k.encode()) for k in known} == known
    assert [sketches.bits_per_key(p) for p in (0.01, 0.001, 0.0001, 0.00001)] == [7, 10, 14, 17]


def test_bloom_error_rate():
    mediocre = good = 0
    probes = [sketches.bloom_hash((10**9 + i).to_bytes(4, "little")) for i in range(10_000)]
    for n in [d * 10**e for e in range(4) for d in range(1, 10)] + [10_000]:
        own = [sketches.bloom_hash(i.to_bytes(4, "little")) for i in range(n)]
        bloom = sketches.bloom_build(own, 0.001)
        assert len(bloom) < 10 * n / 8 + 40 and sketches.bloom_has(bloom, own).all()
        rate = sketches.bloom_has(bloom, probes).mean()
        assert rate <= 0.02
        mediocre, good = (mediocre + 1, good) if rate > 0.0125 else (mediocre, good + 1)
    assert mediocre * 5 <= good


def test_codecs(spark):
    rows = [(b"", 0, 7, 3, 0, b""), (b"key", 2**62, 255, 128, 123456789, b"abc"), (b"\x00", 1, 0, 1, 127, b"\xff"), (b"k", 1, 0, 1, 128, None)]
    df = spark.createDataFrame([(bytearray(k), v, u, m, e, x and bytearray(x)) for k, v, u, m, e, x in rows[:3]], "user_key binary, version bigint, user_meta int, meta int, expires_at bigint, value binary")
    packed = df.select(codecs.encode_key("user_key", "version").alias("k"), codecs.encode_value(F.col("user_meta"), F.col("meta"), F.col("expires_at"), F.coalesce("value", F.lit(b""))).alias("v"))
    got = packed.select(codecs.decode_key("k").alias("k"), codecs.decode_value("v").alias("v"), F.octet_length("v").alias("n")).collect()
    assert [(bytes(r.k.user_key), r.k.version, r.v.user_meta, r.v.meta, r.v.expires_at, bytes(r.v.value)) for r in got] == rows[:3]
    assert got[1].n == 9
    ptr = spark.sql("select struct(1 as fid, 2 as len, 2147483647 as offset) as p").select(codecs.encode_pointer("p").alias("b")).select("b", codecs.decode_pointer("b").alias("p")).first()
    assert len(ptr.b) == 12 and tuple(ptr.p) == (1, 2, 2147483647)


def test_checksums_and_encryption(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b""),), (None,)], "value binary")
    good = integrity.with_checksum(df, "value")
    assert integrity.corrupt(good, "value").count() == 0
    assert integrity.corrupt(good.withColumn("value", F.concat("value", F.lit(b"x"))), "value").count() == 2
    for key in (b"0" * 16, b"1" * 32):
        sealed = df.select("value", integrity.encrypted(F.col("value"), F.lit(key)).alias("s"))
        assert sealed.where("s = value").count() == 0
        assert sealed.where(~integrity.decrypted(F.col("s"), F.lit(key)).eqNullSafe(F.col("value"))).count() == 0


def test_watermark_against_heap(spark):
    r = random.Random(4)
    for _ in range(4):
        begun = sorted(r.sample(range(1, 50), 20))
        marks = [(t, False) for t in begun] + [(t, True) for t in begun if r.random() < 0.8]
        open_ = {t for t in begun if (t, True) not in marks}
        want = max((t for t in begun if not open_ or t < min(open_)), default=0)
        assert txns.watermark(spark.createDataFrame(marks, "ts bigint, done boolean")).first().done_until == want
    assert txns.watermark(spark.createDataFrame([], "ts bigint, done boolean")).first().done_until == 0


def test_conflicts_in_order_of_commit(spark):
    r = random.Random(5)
    for _ in range(3):
        n = 40
        reads = {t: {r.randrange(12) for _ in range(2)} for t in range(1, n)}
        writes = {t: {r.randrange(12) for _ in range(2)} for t in range(1, n)}
        at = {t: max(0, t - 1 - r.randrange(6)) for t in range(1, n)}
        exact, last = set(), {}
        for t in range(1, n):
            if any(last.get(k, -1) > at[t] for k in reads[t]):
                exact.add(t)
            else:
                last.update(dict.fromkeys(writes[t], t))
        rd = spark.createDataFrame([(t, k, at[t], t) for t in reads for k in reads[t]] + [(99, None, 0, 99)], "txn_id bigint, key bigint, read_ts bigint, commit_ts bigint")
        wd = spark.createDataFrame([(t, k) for t in writes for k in writes[t]] * 2, "commit_ts bigint, key bigint")
        assert {x.txn_id for x in txns.conflicts_resolved(rd, wd).collect()} == exact
        maybe = {t for t in reads if any(k in writes[w] for k in reads[t] for w in range(at[t] + 1, t))}
        assert {x.txn_id for x in txns.conflict_candidates(rd, wd).collect()} == maybe
        outcome = txns.resolve([(t, at[t], reads[t], writes[t]) for t in range(1, n)])
        assert all(isinstance(x, bool) for x in outcome.values())


def test_long_chains_of_conflicts(spark):
    # One hot key, read and written by all, and keys by chance: more rounds than allowed.
    r = random.Random(8)
    for hot, n, back in ((True, 60, 1), (True, 300, 7), (False, 300, 40)):
        reads = {t: {0 if hot else r.randrange(3), r.randrange(1, 9)} for t in range(1, n)}
        writes = {t: {0 if hot else r.randrange(3), r.randrange(1, 9)} for t in range(1, n)}
        at = {t: max(0, t - 1 - r.randrange(back, back + 3)) for t in range(1, n)}
        exact, last = set(), {}
        for t in range(1, n):
            if any(last.get(k, -1) > at[t] for k in reads[t]):
                exact.add(t)
            else:
                last.update(dict.fromkeys(writes[t], t))
        rd = spark.createDataFrame([(-t, k, at[t], t) for t in reads for k in reads[t]], "txn_id bigint, key bigint, read_ts bigint, commit_ts bigint")
        wd = spark.createDataFrame([(t, k) for t in writes for k in writes[t]], "commit_ts bigint, key bigint")
        for rounds in (0, 2):
            got = txns.conflicts_resolved(rd, wd, rounds).collect()
            assert sorted((x.txn_id, x.commit_ts) for x in got) == sorted((-t, t) for t in exact)


def test_overlap_counts(spark):
    r = random.Random(6)
    rows = []
    for i in range(60):
        a, b = sorted(r.randrange(30) for _ in range(2))
        rows.append((i, r.randrange(1, 4), bytearray([a]), bytearray([b]), r.choice([None, 10])))
    rows.append((99, 2, None, None, 1))
    got = {x.table_id: (x.n_overlaps, x.overlap_bytes) for x in tables.overlap_counts(spark.createDataFrame(rows, "table_id int, level int, smallest binary, biggest binary, on_disk_size bigint")).collect()}
    for i, level, a, b, _ in rows[:-1]:
        hit = [y for y in rows[:-1] if y[1] == level + 1 and a <= y[3] and y[2] <= b]
        assert got[i] == (len(hit), sum(y[4] or 0 for y in hit))
    assert 99 not in got


def test_prefix_overlap(spark):
    keys = [b"abc", b"abd", b"abcd", b"b", b""]
    df = spark.createDataFrame([(bytearray(k), 1) for k in keys[:3]] + [(bytearray(k), 2) for k in keys[3:]], "user_key binary, block int")
    assert {bytes(r.user_key): r.shared for r in tables.prefix_overlap(df, ["block"]).collect()} == {b"abc": 3, b"abd": 2, b"abcd": 3, b"b": 0, b"": 0}


def test_recovery_stops_at_first_broken_batch(spark):
    rows = [(1, 1, 10, True, False), (1, 2, 10, True, True), (1, 3, 11, True, False), (1, 4, 12, True, False), (1, 5, 12, True, True), (2, 1, 13, False, False), (2, 2, 14, True, False), (2, 3, 14, True, True)]
    got = txns.recovered(spark.createDataFrame(rows, "fid int, pos int, txn_ts int, is_txn boolean, is_fin boolean")).collect()
    assert {(r.fid, r.pos) for r in got} == {(1, 1), (2, 1), (2, 2)}


def test_write_errors(spark):
    rows = [(None, b""), (b"", b""), (b"!sys!x", b""), (b"k" * 65_001, b""), (b"k", b"v" * 11), ((7).to_bytes(8, "big") + b"x", b""), ((7).to_bytes(8, "big"), b""), (b"ok", None)]
    df = spark.createDataFrame([(k if k is None else bytearray(k), v if v is None else bytearray(v)) for k, v in rows], "user_key binary, value binary")
    got = [r.e for r in df.select(S.write_error(10, [7], 0).alias("e")).collect()]
    assert got == ["EmptyKey", "EmptyKey", "InvalidKey", "InvalidKey", "ValueLogSize", "BannedKey", None, None]


@pytest.mark.parametrize("heavy_rows", [10, 100_000])
def test_merge_entries(spark, heavy_rows, monkeypatch):
    monkeypatch.setattr(merge, "unique_join", lambda a, b, k, by: __import__("tesselkv.operators.skew", fromlist=["x"]).unique_join(a, b, k, by, heavy_rows=heavy_rows))
    rows = [(b"hot", v, b"x" * v, 8 if v % 10 else 64, 0) for v in range(1, 36)]
    rows += [(b"a", 1, b"1", 8, 0), (b"a", 2, b"22", 8, 0), (b"d", 1, b"1", 64, 0), (b"d", 2, b"", 1, 0), (b"d", 3, b"333", 8, 0), (b"e", 1, b"1", 64, 50), (b"b", 1, b"", 0, 0)]
    got = merge.merge_entries(kv(spark, rows), 100, [F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes")]).collect()
    assert {bytes(r.user_key): (r.n, r.bytes) for r in got} == {b"hot": (6, sum(range(30, 36))), b"a": (2, 3), b"d": (1, 3)}
    early = merge.merge_entries(kv(spark, rows), 0, [F.max("version").alias("v")], read_ts=19).collect()
    assert {bytes(r.user_key): r.v for r in early} == {b"hot": 19, b"a": 2, b"d": 3, b"e": 1}


def test_extra_columns_that_clash(spark):
    rows = kv(spark, [(b"k", v, b"x" * v, 64, 0) for v in range(1, 6)])
    extra = ["n", "salt", "line", "gone", "elig", "rank", "top", "part", "lookup_id", "kind", "v", "at"]
    wide = rows.withColumns({c: F.lit(f"mine {c}") for c in extra})
    judged = retention.judged(wide, 0, 9, keep=2)
    assert [r.version for r in retention.kept(judged).orderBy("version").collect()] == [4, 5]
    apart, log = values.separated(wide, 3, 100, ["user_key", "version"])
    asked = spark.createDataFrame([(1, bytearray(b"k"), 3)], "lookup_id bigint, user_key binary, read_ts bigint")
    got = snapshot.multi_get(asked, wide.drop("lookup_id"), 0).collect()
    assert log.count() == 3 and got[0].version == 3 and got[0].n == "mine n"
    for df in (judged, apart, snapshot.snapshot(wide, 0), merge.merge_sources([wide, wide])):
        assert all(r[c] == f"mine {c}" for r in df.collect() for c in extra)


def test_bloom_hashes_together():
    r = random.Random(6)
    made = [r.randbytes(r.randrange(0, 40)) for _ in range(500)] + [b"", b"\xff" * 9]
    assert sketches.bloom_hashes(made).tolist() == [sketches.bloom_hash(k) for k in made]
    assert sketches.bloom_hashes([]).tolist() == []
