"""Queries p1, p3 and p5: skewed keys, small files, change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselkv.operators.changefeed import apply_changes, existing, merged_changes
from tesselkv.operators.skew import Merged, late_rows, salted_aggregate
from tesselkv.operators.smallfiles import concatenate, file_layout, merge_outputs, plan_merges, retire, write_lines
from tesselkv.runtime import shared_path, table, written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "kv_record").select("arrival", "user_key", "version")
    return late_rows(rows, "user_key", "arrival", "version").select("arrival")


def p1_key_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "kv_record").select("arrival", "user_key", "version", F.octet_length("value").alias("n"))
    totals = [
        Merged("n_rows", F.count(F.lit(1)), F.sum),
        Merged("max_version", F.max("version"), F.max),
        Merged("first_arrival", F.min("arrival"), F.min),
        Merged("last_arrival", F.max("arrival"), F.max),
        Merged("value_bytes", F.sum(F.coalesce("n", F.lit(0)).cast("bigint")), F.sum),
    ]
    return salted_aggregate(rows, ["user_key"], totals, ["arrival"]).withColumn("user_key", F.hex("user_key"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return plan_merges(table(spark, d, "table_info")).select("table_id", "level")


def p3_outputs(spark: SparkSession, d: str) -> DataFrame:
    return merge_outputs(plan_merges(table(spark, d, "table_info")))


def p3_plan(spark: SparkSession, d: str) -> DataFrame:
    return plan_merges(table(spark, d, "table_info"))


def p3_joined(spark: SparkSession, d: str) -> DataFrame:
    """The plan carried out: a file of lines per small table, its listings; joined, the inputs
    deleted, and all lines read back from what is left.
    """
    plan, at = written(plan_merges(table(spark, d, "table_info")), "plan"), shared_path(spark, "small")
    spark.createDataFrame([], "x string").write.text(at)  # the folder
    to = F.concat(F.lit(f"{_uri(at)}/t"), F.col("table_id").cast("string"))
    rows = table(spark, d, "table_info").join(plan.select("table_id"), "table_id", "left_semi")
    line = F.to_json(F.struct("listing_id", "table_id", "on_disk_size"))
    files = written(write_lines(rows.select(to.alias("to"), line.alias("line"), "listing_id"), "to", "line", ["listing_id"]), "files")
    ids = files.withColumn("table_id", F.regexp_extract("path", r"/t(-?[0-9]+)$", 1).cast("int"))
    layout = written(file_layout(plan, ids, f"{_uri(at)}/joined"), "layout")
    report = written(concatenate(layout), "report")
    retire(layout, report).agg(F.sum("n_deleted")).collect()
    text = spark.read.option("recursiveFileLookup", "true").text(at)
    return text.select(F.from_json("value", "listing_id bigint, table_id int, on_disk_size bigint").alias("r")).select("r.*")


def _uri(at: str) -> str:
    """A path of the shared folder for pyarrow, which asks for three slashes."""
    return at if "://" in at else "file://" + at.removeprefix("file:")


def p5_merged_in_parts(spark: SparkSession, d: str) -> DataFrame:
    """The feed in three parts, out of order, each merged into the state the last one left."""
    feed, state = table(spark, d, "manifest_changes"), None
    part = F.pmod(F.xxhash64("feed_pos"), F.lit(3))
    for i in (2, 0, 1):
        state = merged_changes(state, feed.where(part == i), "table_id", "seq", "op", ["level"])
    return existing(state, "op").select("table_id", "seq", "level")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "manifest_changes")
    return apply_changes(None, feed, "table_id", "seq", "op", ["level"]).select("table_id", "level")


_P3_PLAN = """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY listed_at DESC NULLS LAST, listing_id DESC) AS r FROM table_info),
s AS (SELECT table_id, on_disk_size, row_number() OVER (PARTITION BY table_id ORDER BY listed_at DESC NULLS LAST, listing_id DESC) AS r FROM table_info WHERE on_disk_size > 0),
f AS (SELECT a.table_id, a.level, a.smallest, coalesce(a.key_count, 0) AS key_count, s.on_disk_size AS n_bytes
  FROM a JOIN s USING (table_id) WHERE a.r = 1 AND s.r = 1 AND s.on_disk_size < 524288),
p AS (SELECT level, table_id, key_count, n_bytes,
  CAST(coalesce(sum(n_bytes) OVER (PARTITION BY level ORDER BY smallest NULLS FIRST, table_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start FROM f)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_key_totals, p3_found, p3_plan, p3_outputs, p3_joined, p5_found, p5_merged_in_parts)}

ORACLE = {
    "p1_found": """
SELECT arrival FROM (SELECT arrival, version, max(version) OVER (PARTITION BY user_key ORDER BY arrival
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM kv_record WHERE user_key IS NOT NULL) WHERE best > version""",
    "p1_key_totals": """
SELECT hex(user_key) AS user_key, count(*) AS n_rows, max(version) AS max_version, min(arrival) AS first_arrival, max(arrival) AS last_arrival,
  CAST(coalesce(sum(octet_length(value)), 0) AS BIGINT) AS value_bytes FROM kv_record GROUP BY kv_record.user_key""",
    "p3_found": _P3_PLAN + "SELECT table_id, level FROM p",
    "p3_plan": _P3_PLAN + "SELECT level, line_start // 8388608 AS output, table_id, key_count, n_bytes, line_start FROM p",
    "p3_outputs": _P3_PLAN
    + """SELECT level, line_start // 8388608 AS output, count(*) AS n_tables, CAST(sum(key_count) AS BIGINT) AS key_count,
  CAST(sum(n_bytes) AS BIGINT) AS n_bytes, true AS contiguous FROM p GROUP BY 1, 2""",
    "p3_joined": _P3_PLAN + "SELECT listing_id, table_id, on_disk_size FROM table_info SEMI JOIN p USING (table_id)",
    "p5_merged_in_parts": """
SELECT table_id, seq, level FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY seq DESC) AS r FROM manifest_changes)
WHERE r = 1 AND upper(trim(op)) IN ('CREATE', '0')""",
    "p5_found": """
SELECT table_id, level FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY seq DESC) AS r FROM manifest_changes)
WHERE r = 1 AND upper(trim(op)) IN ('CREATE', '0')""",
}
