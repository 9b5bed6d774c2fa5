"""Skew, small files and change feeds, against brute force."""

import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from tesselkv.operators import changefeed as cf
from tesselkv.operators import ordered, skew
from tesselkv.operators import smallfiles as sf

ROWS = "arrival bigint, user_key binary, version bigint, salt int"


def late(rows):
    out = []
    for a, k, v, _ in rows:
        if None not in (a, k, v) and any(k2 == k and a2 is not None and a2 < a and v2 is not None and v2 > v for a2, k2, v2, _ in rows):
            out.append(a)
    return sorted(out)


@pytest.mark.parametrize("heavy_rows", [10, 10_000])
def test_late_rows(spark, heavy_rows):
    r = random.Random(heavy_rows)
    rows = [(i, b"hot" if r.random() < 0.5 else bytes([r.randrange(40)]), i + r.randrange(-6, 7), 1) for i in range(200)]
    rows += [(3, b"hot", None, 1), (None, b"hot", 4, 1), (5, None, 6, 1), (50, b"hot", 1, 1), (50, b"hot", 99, 1), rows[7], rows[7]]
    df = spark.createDataFrame([(a, k and bytearray(k), v, s) for a, k, v, s in rows], ROWS)
    got = skew.late_rows(df, "user_key", "arrival", "version", heavy_rows)
    assert got.columns == df.columns
    assert sorted(x.arrival for x in got.collect()) == late(rows)


def test_late_rows_empty(spark):
    assert skew.late_rows(spark.createDataFrame([], ROWS), "user_key", "arrival", "version").collect() == []


def test_salted_aggregate(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i, "x") for i in range(100)], "k string, n int, salt string")
    m = [skew.Merged("rows", F.count(F.lit(1)), F.sum), skew.Merged("top", F.max("n"), F.max)]
    got = {r.k: (r.rows, r.top) for r in skew.salted_aggregate(df, ["k"], m, ["n"], heavy_rows=10, salts=4).collect()}
    assert got == {"a": (66, 98), None: (34, 99)}
    assert skew.salted_aggregate(df.limit(0), ["k"], m, ["n"]).collect() == []


def test_unique_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else str(i)) for i in range(100)] + [(100, None)], "i int, k string")
    facts = spark.createDataFrame([("hot", 1), ("4", 2), ("none", 3)], "k string, salt int")
    for heavy in (10, 1000):
        got = skew.unique_join(rows, facts, "k", "i", heavy_rows=heavy)
        assert sorted((r.i, r.salt) for r in got.collect()) == sorted([(i, 1) for i in range(1, 100, 2)] + [(4, 2)])


def test_running_sum_and_rank(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, r.choice([None, 1, 5])) for i in range(300)] + [(None, 1, 2), (None, 2, 3)]
    got = ordered.running_sum(spark.createDataFrame(rows, "g string, before int, n int"), ["g"], ["before"], "n", "upto").collect()
    for x in got:
        assert x.upto == sum(n or 0 for g, i, n in rows if g == x.g and i < x.before)
    df = spark.createDataFrame([(g, i) for g, i, _ in rows], "g string, i int")
    got = ordered.salted_rank(df, ["g"], ["i"], rows_per_salt=50).collect()
    for g in ("a", "b", None):
        assert sorted(x["rank"] for x in got if x.g == g) == list(range(sum(y[0] == g for y in rows)))
    assert ordered.running_sum(df.limit(0).withColumn("n", F.lit(1)), ["g"], ["i"], "n").collect() == []


LISTING = "listing_id bigint, table_id int, level int, smallest binary, biggest binary, key_count bigint, on_disk_size bigint, listed_at timestamp"


def test_plan_merges(spark):
    from datetime import datetime as dt

    t = [dt(2025, 1, d) for d in range(1, 9)]
    rows = [
        (1, 1, 0, b"a", b"b", 5, 100, t[0]), (2, 1, 2, b"a", b"b", 5, None, t[1]), (3, 2, 1, b"c", b"d", None, 600_000, t[0]), (4, 2, 1, b"c", b"d", 7, 300, t[3]),
        (5, 3, 1, b"a", b"b", 2, 0, t[0]), (6, 4, 1, None, None, 1, 50, None), (7, 4, 1, None, None, 1, 700_000, t[0]), (8, 5, None, b"x", b"y", 1, 10, t[0]), (8, 5, None, b"x", b"y", 1, 10, t[0]), (9, None, 1, b"", b"", 1, 1, t[0]),
    ]
    plan = sf.plan_merges(spark.createDataFrame(rows, LISTING), target=1000).collect()
    assert {(r.table_id, r.level, r.n_bytes) for r in plan} == {(1, 2, 100), (2, 1, 300), (5, None, 10)}
    assert sf.plan_merges(spark.createDataFrame([], LISTING)).collect() == []


def test_plan_is_whole(spark):
    r = random.Random(3)
    rows = [(i, i, r.randrange(3), bytes([r.randrange(256)]), b"z", 1, r.randrange(1, 400), None) for i in range(500)]
    plan = sf.plan_merges(spark.createDataFrame(rows, LISTING), small=400, target=2000)
    assert plan.count() == plan.select("table_id").distinct().count() == 500
    outs = sf.merge_outputs(plan).collect()
    assert all(o.contiguous and o.n_bytes < 2400 for o in outs)
    assert sum(o.key_count for o in outs) == 500 and sum(o.n_bytes for o in outs) == sum(x[6] for x in rows)


def put(folder, name, data):
    at = folder / name
    at.write_bytes(data)
    return f"file://{at}"


def test_concatenate_lines(spark, tmp_path):
    parts = [b"id,x\n1,a\n2,b", b"", b"\xef\xbb\xbfid,x\n3,c\n", b"id,x", b"id,x\n4,d\n"]
    rows = [(f"file://{tmp_path}/out", i, put(tmp_path, f"p{i}", p)) for i, p in enumerate(parts)] + [(None, 1, "x"), ("y", 1, None)]
    layout = spark.createDataFrame(rows, "out string, place int, path string")
    (r,) = sf.concatenate(layout, with_header=True).collect()
    data = (tmp_path / "out").read_bytes()
    assert data == b"id,x\n1,a\n2,b\n3,c\n4,d\n"
    assert (r.n_inputs, r.bytes_out, r.crc32) == (5, len(data), zlib.crc32(data))
    bad = spark.createDataFrame([(f"file://{tmp_path}/bad", 0, rows[0][2]), (f"file://{tmp_path}/bad", 1, put(tmp_path, "q", b"other\n1\n"))], layout.schema)
    with pytest.raises(Exception, match="header differs"):
        sf.concatenate(bad, with_header=True).collect()
    assert not (tmp_path / "bad").exists()
    assert sf.concatenate(layout.limit(0)).collect() == []


def test_concatenate_zstd(spark, tmp_path):
    texts = [b"a\n" * 1000, b"b" * 300_000, b"", b"c"]
    made = [zstandard.ZstdCompressor(write_checksum=i % 2 == 0, write_content_size=i != 1).compress(t) for i, t in enumerate(texts)]
    made.append(b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc")
    rows = [(f"file://{tmp_path}/z", i, put(tmp_path, f"z{i}", p)) for i, p in enumerate(made)]
    (r,) = sf.concatenate(spark.createDataFrame(rows, "out string, place int, path string"), "zstd").collect()
    data = (tmp_path / "z").read_bytes()
    assert data == b"".join(made) and r.bytes_in == r.bytes_out == len(data)
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(texts)
    cut = spark.createDataFrame([(f"file://{tmp_path}/c", 0, put(tmp_path, "cut", made[1][:-1]))], "out string, place int, path string")
    with pytest.raises(Exception, match="cut off"):
        sf.concatenate(cut, "zstd").collect()


def test_frames_found_without_decompression():
    one = zstandard.ZstdCompressor().compress(b"x" * 1000)
    assert sf.frame_ends(one * 3) == [len(one), 2 * len(one), 3 * len(one)]
    assert sf.frame_ends(b"") == []
    with pytest.raises(sf.BadInput):
        sf.frame_ends(b"not a frame")


FEED = "table_id int, seq bigint, op string, level int, rank string"


def test_apply_changes(spark):
    rows = [(1, 1, "CREATE", 0, "r"), (1, 5, " create ", 2, "r"), (1, 5, "0", 2, "q"), (2, 2, "0", 1, ""), (2, 3, "1", None, ""), (3, 4, "Delete", None, ""), (4, 6, "what", 1, ""), (None, 7, "0", 1, ""), (5, None, "0", 1, ""), (6, 9, "0", None, "")]
    feed = spark.createDataFrame(rows, FEED)
    want = {(1, 5, 2), (6, 9, None)}
    assert {tuple(r) for r in cf.apply_changes(None, feed, "table_id", "seq", "op", ["level"]).collect()} == want
    base = cf.apply_changes(None, feed, "table_id", "seq", "op", ["level"])
    assert {tuple(r) for r in cf.apply_changes(base, feed, "table_id", "seq", "op", ["level"]).collect()} == want
    more = spark.createDataFrame([(1, 4, "DELETE", None, ""), (6, 10, "DELETE", None, "")], FEED)
    assert {tuple(r) for r in cf.apply_changes(base, more, "table_id", "seq", "op", ["level"]).collect()} == {(1, 5, 2)}
    assert cf.apply_changes(None, feed.limit(0), "table_id", "seq", "op", ["level"]).collect() == []


def late_fast(rows):
    """Arrivals of late rows, each row once: equal arrivals do not precede each other."""
    by, best, out = {}, {}, []
    for a, k, v in rows:
        by.setdefault(a, []).append((k, v))
    for a in sorted(by):
        out += [a for k, v in by[a] if best.get(k, v) > v]
        for k, v in by[a]:
            best[k] = max(v, best.get(k, v))
    return out


@pytest.mark.parametrize("kind", ["outlier", "burst", "many"])
def test_slices_do_not_collapse(spark, kind):
    r = random.Random(3)
    n = 20_000
    if kind == "many":  # many heavy keys, none more than a small part of the rows
        rows = [(i, i % 500, i + r.randrange(-900, 900)) for i in range(n)]
    else:
        rows = [(i if kind == "outlier" else 10**12 + i // 2, 0 if r.random() < 0.6 else 1 + r.randrange(2000), i + r.randrange(-9, 9)) for i in range(n)]
        rows += [(2**63 - 1, 0, 5), (-(2**63), 0, 5)] if kind == "outlier" else [(5, 0, 10**9)]
    df = spark.createDataFrame([(a, bytearray(str(k).encode()), v, 1) for a, k, v in rows], ROWS)
    heavy = 20 if kind == "many" else 1000
    cut, any_heavy = skew.sliced(df, "user_key", "arrival", "slice", "part", ["version"], heavy)
    assert any_heavy and cut.groupBy("user_key", "slice", "part").count().agg(F.max("count")).first()[0] <= 2 * heavy + 200
    got = sorted(x.arrival for x in skew.late_rows(df, "user_key", "arrival", "version", heavy).collect())
    assert got == late_fast(rows)


def test_a_tie_of_a_third_of_all_rows_is_spread(spark):
    rows = [(7 if i % 3 == 0 else i, 0, i) for i in range(9000)]
    df = spark.createDataFrame([(a, bytearray(b"k"), v, 1) for a, _, v in rows], ROWS)
    cut, _ = skew.sliced(df, "user_key", "arrival", "slice", "part", ["version"], 500)
    assert cut.groupBy("slice", "part").count().agg(F.max("count")).first()[0] <= 1300
    got = sorted(x.arrival for x in skew.late_rows(df, "user_key", "arrival", "version", 500).collect())
    assert got == late_fast(rows)


def test_threshold_follows_the_input(spark):
    few = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    assert len(skew.heavy_hashes(few, ["k"])) == 1  # a third of all rows is heavy at any size above LEAST_ROWS
    assert skew.heavy_hashes(few.limit(500), ["k"]) == []


def test_outputs_of_one_plan_carried_out(spark, tmp_path):
    files = [(i, put(tmp_path, f"t{i}", b"%d\n" % i * (i + 1)), None) for i in range(6)]
    listing = [(i, i, 0 if i < 4 else None, bytes([i]), bytes([i]), i + 1, 2 * (i + 1), None) for i in range(5)] + [(9, 5, 3, b"x", b"y", 6, 12, None)]
    plan = sf.plan_merges(spark.createDataFrame(listing, LISTING), target=1000)
    known = spark.createDataFrame([(i, p, 2 * (i + 1)) for i, p, _ in files], "table_id int, path string, n_bytes bigint")
    layout = sf.file_layout(plan, known, f"file://{tmp_path}/joined", ".txt")
    assert {r.path.rpartition("/")[2] for r in layout.collect()} == {"t0", "t1", "t2", "t3"}  # single ones stay
    report = spark.createDataFrame(sf.concatenate(layout).collect())
    assert [(r.n_inputs, r.n_lines, r.bytes_in) for r in report.collect()] == [(4, 10, 20)]
    assert (tmp_path / "joined/0/0.txt").read_bytes() == b"".join(b"%d\n" % i * (i + 1) for i in range(4))
    short = report.withColumn("n_inputs", F.lit(3).cast("bigint"))
    assert sf.retire(layout, short).collect() == [] and (tmp_path / "t0").exists()
    assert [tuple(r) for r in sf.retire(layout, report).collect()] == [(f"file://{tmp_path}/joined/0/0.txt", 4)]
    assert not (tmp_path / "t0").exists() and (tmp_path / "t4").exists()
    wrong = known.withColumn("n_bytes", F.col("n_bytes") + 1).where("table_id < 4")
    for i in range(4):
        put(tmp_path, f"t{i}", b"%d\n" % i * (i + 1))
    with pytest.raises(Exception, match="were planned"):
        sf.concatenate(sf.file_layout(plan.where("level = 0"), wrong, f"file://{tmp_path}/again")).collect()
    assert not (tmp_path / "again/0/0").exists()
    with pytest.raises(Exception, match="no file of table"):
        sf.file_layout(plan.where("level = 0"), known.limit(1), f"file://{tmp_path}/again").collect()


def test_long_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sf, "CHUNK", 7)
    big = zstandard.ZstdCompressor(write_checksum=True).compress(random.Random(1).randbytes(1000))
    made = sf._Output(f"file://{tmp_path}/o", "zstd", False)
    for i in range(2):
        made.add(put(tmp_path, f"b{i}", big), len(big))
    assert made.close()["bytes_out"] == 2 * len(big) and (tmp_path / "o").read_bytes() == big * 2
    one, two = (sf._Output(f"file://{tmp_path}/l", "lines", True) for _ in range(2))  # two attempts at once
    for o in (one, two):
        o.add(put(tmp_path, "l0", b"a long header line\n" + b"x" * 30), None)
        o.add(put(tmp_path, "l1", b"a long header line\ny"), None)
    one.close()
    assert two.close()["n_lines"] == 2 and (tmp_path / "l").read_bytes() == b"a long header line\n" + b"x" * 30 + b"\ny\n"
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []


def test_late_changes_find_deletes(spark):
    feed = spark.createDataFrame([(1, 10, "DELETE", None, ""), (2, 4, "CREATE", 3, "")], FEED)
    late = spark.createDataFrame([(1, 5, "CREATE", 2, ""), (2, 3, "DELETE", None, ""), (2, 4, " 0", 3, ""), (2, 4, "create", 1, "")], FEED)
    args = ("table_id", "seq", "op", ["level"])
    for parts in ((feed, late), (late, feed), (feed, late, feed)):
        state = None
        for p in parts:
            state = cf.merged_changes(state, p, *args)
        assert {tuple(r) for r in cf.existing(state, "op").collect()} == {(2, 4, 3)}  # copies that differ: the greatest
    held = cf.merged_changes(None, feed, *args)
    assert {tuple(r) for r in cf.apply_changes(held, late, *args).collect()} == {(2, 4, 3)}
