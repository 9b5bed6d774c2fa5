"""Queries p2, p4, p6, p7 and p8, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselkv.llm import packing, seen, subjects, tokenize
from tesselkv.llm import percentiles as pc
from tesselkv.runtime import shared_path, table

PCTS = (50, 90, 99)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "kv_record").select("user_key")
    incoming = table(spark, d, "kv_incoming").select("incoming_id", "user_key")
    return seen.seen_before(history, incoming, "user_key", "incoming_id").select("incoming_id")


def p2_error_rate(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "kv_record").select("user_key")
    incoming = table(spark, d, "kv_incoming").select("incoming_id", "user_key")
    return seen.error_rate(history, incoming, "user_key", "incoming_id")


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two successive batches, asked and added to chains that are kept."""
    history = table(spark, d, "kv_record").select("user_key")
    incoming = table(spark, d, "kv_incoming").select("incoming_id", "user_key")
    store = seen.SeenStore(spark, shared_path(spark, "chains"))
    store.add(history, "user_key")
    halves = [incoming.where(F.col("incoming_id") % 2 == i) for i in (0, 1)]
    return seen.batch_reports(history, halves, "user_key", "incoming_id", store).select("batch", "asked", "new_keys", "within")


def _p4_percentiles(spark: SparkSession, d: str, exact: bool = True) -> DataFrame:
    """``exact`` keeps numbers of more than 38 digits as they are, as ``wide`` numbers."""
    # Copies of an entry or a record are equal in what is taken here; where they are
    # not, the smallest number and stream count.
    log = table(spark, d, "vlog_entry").select("fid", "entry_pos", "value_len").where("value_len >= 0")
    log = log.groupBy("fid", "entry_pos").agg(F.min("value_len").alias("x"))
    log = log.select(F.lit("vlog_entry").alias("src"), F.col("fid").cast("bigint").alias("grp"), F.col("x").cast("decimal(38,0)").alias("x")).where("grp IS NOT NULL")
    log = log.withColumn("x", pc.wide(F.col("x"))) if exact else log
    kv = table(spark, d, "kv_record").select("user_key", "version", "stream_id", "user_meta", "value")
    text = F.when(F.col("user_meta") == 2, F.col("value").cast("string"))
    number = F.when(F.col("user_meta") == 1, pc.big_endian(F.col("value"))).otherwise(pc.whole_number(text))
    number = pc.wide(number, text) if exact else number
    kv = kv.where(F.col("user_meta").isin(1, 2) & F.col("stream_id").isNotNull()).withColumn("x", number).where("x IS NOT NULL")
    kv = kv.groupBy("user_key", "version").agg(F.min("stream_id").alias("stream_id"), F.min("x").alias("x"))
    kv = kv.select(F.lit("kv_record").alias("src"), F.col("stream_id").cast("bigint").alias("grp"), "x")
    by = ["src", "grp"]
    counts = pc.combined([pc.partial_counts(log, by, "x"), pc.partial_counts(kv, by, "x")], by, "x")
    return pc.percentiles(counts, by, "x", PCTS, pc.wide_double) if exact else pc.percentiles(counts, by, "x", PCTS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4_percentiles(spark, d, exact=False).where("nearest >= 4096").select("src", "grp", "pct")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = _p4_percentiles(spark, d)
    return p.select("src", "grp", "pct", "n", pc.wide_text(F.col("nearest")).alias("nearest"), F.round("between", 3).alias("between"))


def p4_between(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated percentiles in whole numbers, no double in between."""
    p = _p4_percentiles(spark, d)
    exact = pc.exactly_between(pc.wide_text(F.col("low")), pc.wide_text(F.col("high")), F.col("part"))
    return p.select("src", "grp", "pct", exact.alias("between"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"), "doc_id", "text")


def _p7(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_capacity"), "doc_id", "text")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)


def p7_use(spark: SparkSession, d: str) -> DataFrame:
    return packing.use(_p7(spark, d), table(spark, d, "pack_capacity"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    fitted = subjects.fit_classifier(docs, table(spark, d, "subject_label"), table(spark, d, "subject_area"))
    return subjects.classify(docs, fitted)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    found = p8_found(spark, d)
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs")).orderBy("subject")


_P4 = r"""
WITH log AS (SELECT DISTINCT fid, entry_pos, value_len FROM vlog_entry WHERE value_len >= 0),
kv AS (SELECT user_key, version, any_value(stream_id) AS stream_id, any_value(user_meta) AS user_meta, any_value(value) AS value
  FROM kv_record WHERE stream_id IS NOT NULL AND user_meta IN (1, 2) AND value IS NOT NULL GROUP BY user_key, version),
x AS (SELECT 'vlog_entry' AS src, CAST(fid AS BIGINT) AS grp, CAST(value_len AS HUGEINT) AS x FROM log
  UNION ALL SELECT 'kv_record', CAST(stream_id AS BIGINT), CAST(CAST('0x' || hex(value) AS UBIGINT) AS HUGEINT) FROM kv WHERE user_meta = 1 AND octet_length(value) = 8
  UNION ALL SELECT 'kv_record', CAST(stream_id AS BIGINT), TRY_CAST(trim(try(decode(value))) AS HUGEINT) FROM kv
    WHERE user_meta = 2 AND regexp_full_match(try(decode(value)), '\s*\+?[0-9]+\s*')),
r AS (SELECT src, grp, x, row_number() OVER (PARTITION BY src, grp ORDER BY x) AS r, count(*) OVER (PARTITION BY src, grp) AS n FROM x),
q AS (SELECT src, grp, pct, max(n) AS n, min(x) FILTER (WHERE r >= (n * pct + 99) // 100) AS nearest,
  max(x) FILTER (WHERE r = (n - 1) * pct // 100 + 1) AS lo, max(x) FILTER (WHERE r = least((n - 1) * pct // 100 + 2, n)) AS hi
  FROM r, (VALUES (50), (90), (99)) AS p(pct) GROUP BY src, grp, pct)
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_error_rate, p2_batches, p4_found, p4_percentiles, p4_between, p6_ids, p7_packed, p7_use, p8_found, p8_mix)}

ORACLE = {
    "p2_found": """
SELECT incoming_id FROM (SELECT incoming_id, user_key, min(incoming_id) OVER (PARTITION BY user_key) AS first_id FROM kv_incoming WHERE octet_length(user_key) > 0) i
WHERE incoming_id > first_id OR EXISTS (SELECT 1 FROM kv_record k WHERE k.user_key = i.user_key)""",
    "p2_batches": """
WITH i AS (SELECT DISTINCT user_key, incoming_id % 2 AS batch FROM kv_incoming WHERE octet_length(user_key) > 0)
SELECT CAST(batch AS INT) AS batch, count(*) AS asked, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM kv_record k WHERE k.user_key = i.user_key)
  AND NOT (batch = 1 AND EXISTS (SELECT 1 FROM i j WHERE j.batch = 0 AND j.user_key = i.user_key))) AS new_keys, true AS within FROM i GROUP BY batch""",
    "p4_found": _P4 + "SELECT src, grp, pct FROM q WHERE nearest >= 4096",
    "p4_between": _P4
    + """, v AS (SELECT src, grp, pct, lo * 100 + (hi - lo) * ((n - 1) * pct % 100) AS v FROM q)
SELECT src, grp, pct, CAST(v // 100 AS VARCHAR) || '.' || lpad(CAST(v % 100 AS VARCHAR), 2, '0') AS between FROM v""",
    "p4_percentiles": _P4
    + """SELECT src, grp, pct, n, CAST(nearest AS VARCHAR) AS nearest,
  round(CAST(lo AS DOUBLE) + (CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)) * (((n - 1) * pct % 100) / 100.0), 3) AS between FROM q""",
}
