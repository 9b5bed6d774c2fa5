"""Tables of a data directory as records, transactions and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselkv import schema as S
from tesselkv.operators.snapshot import last_written
from tesselkv.runtime import table

#: 2025-01-25T12:00:00Z: within the records' time, so some have expired and some not.
NOW = 1_737_806_400


def records(spark: SparkSession, d: str) -> DataFrame:
    """kv_record as delivered, repeats included, with ``arrival`` and ``stream_id``."""
    kv = table(spark, d, "kv_record")
    vptr = F.when(F.col("vptr").isNotNull(), F.struct("vptr.fid", "vptr.len", F.col("vptr.pos").alias("offset")))
    return kv.select("arrival", "user_key", "version", "value", "expires_at", "user_meta", "meta", vptr.alias("vptr"), "stream_id")


def kv(spark: SparkSession, d: str) -> DataFrame:
    """The records, each version once: of repeated ones the last that arrived."""
    return last_written(records(spark, d), "arrival").select(*S.KV_COLUMNS)


def event_records(spark: SparkSession, d: str) -> DataFrame:
    """The events as records: a key per user, a version per event, TTL on clicks."""
    e = table(spark, d, "events")
    seconds = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    meta = F.when(F.col("event_type") == "error", S.DELETE).when(F.col("event_type") == "signup", S.DISCARD_EARLIER).when(F.col("event_type") == "view", S.MERGE).otherwise(0) + S.TXN
    ttl = F.when(F.col("event_type") == "click", seconds + 86_400 * (1 + F.col("event_id") % 30)).otherwise(F.lit(0))
    return e.where("user_id IS NOT NULL").select(
        F.encode(F.concat(F.lit("user/"), F.col("user_id").cast("string")), "UTF-8").alias("user_key"), (F.col("event_id") + 1).alias("version"), F.encode("props", "UTF-8").alias("value"),
        ttl.cast("bigint").alias("expires_at"), F.lit(0).cast("smallint").alias("user_meta"), meta.cast("smallint").alias("meta"), F.lit(None).cast(S.VPTR).alias("vptr"),
    )


EVENTS_NOW = 1_707_523_200  # 2024-02-10


def txn_reads(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as transactions, one an order: reads are parts of open lines."""
    at = F.col("l_orderkey") + 1
    read_ts = F.greatest(at - 1 - F.col("l_orderkey") % 50, F.lit(0))
    return table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("txn_id"), F.col("l_partkey").alias("key"), read_ts.alias("read_ts"), at.alias("commit_ts"))


def txn_writes(spark: SparkSession, d: str) -> DataFrame:
    """Writes of these transactions: parts of lines that did not come back."""
    return table(spark, d, "lineitem").where("l_returnflag <> 'R'").select((F.col("l_orderkey") + 1).alias("commit_ts"), F.col("l_partkey").alias("key"))


def log_records(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a log: a batch an order, its end mark after its last line, some lost.

    A file holds a thousand orders; orders of ids that end in 37 lack the mark.
    """
    lines = table(spark, d, "lineitem").select(
        F.expr("l_orderkey div 1000").alias("fid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_orderkey").alias("txn_ts"), F.lit(True).alias("is_txn"), F.lit(False).alias("is_fin"), F.col("l_partkey").alias("key")
    )
    marks = table(spark, d, "orders").where("o_orderkey % 100 <> 37").select(F.expr("o_orderkey div 1000").alias("fid"), (F.col("o_orderkey") * 10 + 9).alias("pos"), F.col("o_orderkey").alias("txn_ts"), F.lit(True).alias("is_txn"), F.lit(True).alias("is_fin"), F.lit(None).cast("bigint").alias("key"))
    return lines.unionByName(marks)


def current_tables(spark: SparkSession, d: str) -> DataFrame:
    """table_info by its latest listing, one row a table."""
    t = table(spark, d, "table_info")
    key = F.struct(F.coalesce(F.col("listed_at").cast("string"), F.lit("")), "listing_id")
    last = t.where("table_id IS NOT NULL").groupBy("table_id").agg(F.max_by(F.struct(*[c for c in t.columns if c != "table_id"]), key).alias("r"))
    return last.select("table_id", "r.*")


def log_entries(spark: SparkSession, d: str) -> DataFrame:
    """vlog_entry, each entry once."""
    return table(spark, d, "vlog_entry").dropDuplicates(["fid", "entry_pos"])
