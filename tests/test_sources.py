"""Listings, file streams and streaming thresholds."""

from tesselkv.operators import tables
from tesselkv.sources.listing import files, of_kind
from tesselkv.sources.streams import stream_table
from tesselkv.streaming.thresholds import ThresholdTracker


def test_listing(spark, tmp_path):
    for name, n in (("000012.sst", 5), ("000003.sst", 7), ("000001.vlog", 11), ("LOCK", 1), ("x1.sst", 2)):
        (tmp_path / name).write_bytes(b"x" * n)
    found = files(spark, f"file://{tmp_path}")
    assert [r.file_id for r in of_kind(found, "sst").collect()] == [3, 12]
    assert {r.ext: (r.n_files, r.n_bytes) for r in tables.store_size(found).collect()} == {"sst": (3, 14), "vlog": (1, 11), "": (1, 1)}


def test_stream_of_a_file_and_of_a_folder(spark, tmp_path):
    import duckdb

    duckdb.sql(f"copy (select range as x from range(10)) to '{tmp_path}/one.parquet' (format parquet)")
    spark.range(7).write.parquet(f"file://{tmp_path}/many.parquet")
    for name, n in (("one", 10), ("many", 7)):
        stream = stream_table(spark, f"file://{tmp_path}", name)
        q = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == n


def test_threshold_follows_sizes(spark):
    t = ThresholdTracker(0.9, 10, 10_000)
    assert t.threshold == 10
    batch = spark.createDataFrame([(100,)] * 95 + [(5000,)] * 5 + [(None,)], "size int")
    t.observe(batch, 0)
    t.observe(batch, 0)
    assert sum(t.buckets.values()) == 100 and 99 <= t.threshold <= 101
    t.observe(spark.createDataFrame([(5000,)] * 100, "size int"), 1)
    assert 4900 <= t.threshold <= 5100
    t.clear()
    assert t.threshold == 10
