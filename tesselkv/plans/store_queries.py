"""Queries of the store's own operators, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselkv import schema as S
from tesselkv.functions import codecs, sketches
from tesselkv.operators import integrity, retention, snapshot, tables, txns, values
from tesselkv.operators.merge import differences, merge_entries, merge_sources, overlay
from tesselkv.plans import levels
from tesselkv.runtime import shared_path, table
from tesselkv.sources import adapters as A
from tesselkv.sources.streams import stream_table
from tesselkv.streaming.subscriptions import Subscription, parse_ignore, published, subscribe

QUERIES: dict = {}
ORACLE: dict = {}

NOW = A.NOW
TS = 5000
HOT = b"ctr/grove/33c66152d6"


def _key():
    return F.hex("user_key").alias("user_key")



def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


KV = """kv AS (SELECT user_key, version, value, expires_at, user_meta, meta, vptr, stream_id FROM (SELECT *, row_number() OVER
  (PARTITION BY user_key, version ORDER BY arrival DESC) AS rn FROM kv_record WHERE user_key IS NOT NULL AND version IS NOT NULL) WHERE rn = 1)"""
GONE = f"(meta & 1 <> 0 OR (expires_at <> 0 AND expires_at <= {NOW}))"
REAL = "NOT coalesce(octet_length(value) = 0 AND meta = 0, false)"


def _chosen(ts: int | None = None) -> str:
    upto = "" if ts is None else f" AND version <= {ts}"
    return f"chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY version DESC) AS rk FROM kv WHERE {REAL}{upto}) WHERE rk = 1)"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(_key(), "version", F.hex("value").alias("value"))


SHOW = "hex(user_key) AS user_key, version, hex(value) AS value"


@query("q01_snapshot_latest", f"WITH {KV}, {_chosen()} SELECT {SHOW} FROM chosen WHERE NOT {GONE}")
def _(s: SparkSession, d: str) -> DataFrame:
    return _shown(snapshot.snapshot(A.records(s, d), NOW, arrival="arrival"))


for _ts in (1000, TS, 20_000):

    @query(f"q02_snapshot_as_of_{_ts}", f"WITH {KV}, {_chosen(_ts)} SELECT {SHOW} FROM chosen WHERE NOT {GONE}")
    def _(s: SparkSession, d: str, ts: int = _ts) -> DataFrame:
        return _shown(snapshot.snapshot(A.records(s, d), NOW, ts, "arrival"))


@query("q03_tombstoned_keys", f"WITH {KV}, {_chosen(TS)} SELECT hex(user_key) AS user_key, version FROM chosen WHERE meta & 1 <> 0")
def _(s, d):
    return snapshot.masked(A.records(s, d), NOW, TS, "arrival").where("why = 'deleted'").select(_key(), "version")


@query("q04_expired_keys", f"WITH {KV}, {_chosen(TS)} SELECT hex(user_key) AS user_key, version, expires_at FROM chosen WHERE meta & 1 = 0 AND expires_at <> 0 AND expires_at <= {NOW}")
def _(s, d):
    return snapshot.masked(A.records(s, d), NOW, TS, "arrival").where("why = 'expired'").select(_key(), "version", "expires_at")


@query("q05_point_get", f"WITH {KV}, {_chosen(TS)} SELECT {SHOW} FROM chosen WHERE NOT {GONE} AND user_key = '{HOT.decode()}'::BLOB")
def _(s, d):
    return _shown(snapshot.point_get(A.records(s, d), HOT, NOW, TS, "arrival"))


@query("q06_history", f"WITH {KV} SELECT {SHOW}, CAST(meta AS INT) AS meta, expires_at FROM kv WHERE user_key = '{HOT.decode()}'::BLOB")
def _(s, d):
    return snapshot.history(A.kv(s, d), HOT).select(_key(), "version", F.hex("value").alias("value"), F.col("meta").cast("int").alias("meta"), "expires_at")


@query(
    "q07_multi_get",
    f"""WITH {KV}, hit AS (SELECT i.incoming_id AS lookup_id, kv.*, row_number() OVER (PARTITION BY i.incoming_id ORDER BY kv.version DESC) AS rk
  FROM kv_incoming i JOIN kv ON kv.user_key = i.user_key AND kv.version <= 1 + i.incoming_id * 7 % 20000 WHERE {REAL})
  SELECT lookup_id, {SHOW} FROM hit WHERE rk = 1 AND NOT {GONE}""",
)
def _(s, d):
    asked = table(s, d, "kv_incoming").select(F.col("incoming_id").alias("lookup_id"), "user_key", (1 + F.col("incoming_id") * 7 % 20000).alias("read_ts"))
    return snapshot.multi_get(asked, A.records(s, d).select("arrival", *S.KV_COLUMNS), NOW, arrival="arrival").select("lookup_id", _key(), "version", F.hex("value").alias("value"))


@query("q08_range_scan", f"WITH {KV}, {_chosen()} SELECT {SHOW} FROM chosen WHERE NOT {GONE} AND user_key >= 'gauge:4'::BLOB AND user_key < 'gauge:9'::BLOB")
def _(s, d):
    return _shown(snapshot.scan(A.records(s, d), NOW, arrival="arrival", within=S.in_range(b"gauge:4", b"gauge:9")))


@query("q09_reverse_scan_limit", f"WITH {KV}, {_chosen()} SELECT {SHOW} FROM chosen WHERE NOT {GONE} ORDER BY chosen.user_key DESC LIMIT 100")
def _(s, d):
    return _shown(snapshot.scan(A.records(s, d), NOW, arrival="arrival", reverse=True, limit=100))


@query("q10_prefix_scan", f"WITH {KV}, {_chosen()} SELECT {SHOW} FROM chosen WHERE NOT {GONE} AND starts_with(hex(user_key), hex('sess-'::BLOB))")
def _(s, d):
    return _shown(snapshot.scan(A.records(s, d), NOW, arrival="arrival", within=S.in_prefix(b"sess-")))


@query("q11_seek_ge", f"WITH {KV} SELECT {SHOW} FROM kv WHERE user_key >= 'map/'::BLOB ORDER BY kv.user_key, version DESC LIMIT 50")
def _(s, d):
    return _shown(snapshot.seek(A.kv(s, d), b"map/", 50))


@query(
    "q12_neighbours",
    "WITH k AS (SELECT DISTINCT user_key FROM kv_record WHERE user_key IS NOT NULL) SELECT hex(user_key) AS user_key, hex(lag(user_key) OVER w) AS before, hex(lead(user_key) OVER w) AS after FROM k WINDOW w AS (ORDER BY k.user_key)",
)
def _(s, d):
    return snapshot.neighbours(table(s, d, "kv_record")).select(_key(), F.hex("before").alias("before"), F.hex("after").alias("after"))


@query(
    "q12b_beside",
    f"""SELECT hex(max(user_key) FILTER (WHERE user_key < '{HOT.decode()}'::BLOB)) AS before, hex(min(user_key) FILTER (WHERE user_key > '{HOT.decode()}'::BLOB)) AS after, hex(max(user_key)) AS last FROM kv_record""",
)
def _(s, d):
    return snapshot.beside(table(s, d, "kv_record"), HOT).select(*[F.hex(c).alias(c) for c in ("before", "after", "last")])


def _runs(s, d):
    """Three overlapping runs of the records, newest first."""
    r = A.records(s, d).select("arrival", *S.KV_COLUMNS)
    return [snapshot.last_written(r.where(c), "arrival").drop("arrival") for c in ("arrival % 3 = 0 OR arrival % 7 = 0", "arrival % 3 = 1 OR arrival % 5 = 0", "arrival % 3 = 2 OR arrival % 11 = 0")]


_RUNS = """runs AS (SELECT *, 0 AS p FROM kv_record WHERE arrival % 3 = 0 OR arrival % 7 = 0 UNION ALL SELECT *, 1 FROM kv_record WHERE arrival % 3 = 1 OR arrival % 5 = 0
  UNION ALL SELECT *, 2 FROM kv_record WHERE arrival % 3 = 2 OR arrival % 11 = 0), merged AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY user_key, version ORDER BY p, arrival DESC) AS rn FROM runs) WHERE rn = 1)"""


@query("q13_merge_sources", f"WITH {_RUNS} SELECT {SHOW}, CAST(meta AS INT) AS meta FROM merged")
def _(s, d):
    return merge_sources(_runs(s, d)).select(_key(), "version", F.hex("value").alias("value"), F.col("meta").cast("int").alias("meta"))


@query(
    "q14_pending_overlay",
    f"""WITH {KV}, {_chosen()}, p AS (SELECT user_key, max(incoming_id) AS id FROM kv_incoming WHERE octet_length(user_key) > 0 GROUP BY user_key)
  SELECT coalesce(hex(p.user_key), hex(c.user_key)) AS user_key, CASE WHEN p.id IS NOT NULL THEN {S.MAX_VERSION} ELSE c.version END AS version,
  CASE WHEN p.id IS NOT NULL THEN hex(CAST(p.id AS VARCHAR)::BLOB) ELSE hex(c.value) END AS value FROM chosen c FULL JOIN p ON p.user_key = c.user_key
  WHERE CASE WHEN p.id IS NOT NULL THEN p.id % 5 <> 0 ELSE NOT (c.meta & 1 <> 0 OR (c.expires_at <> 0 AND c.expires_at <= {NOW})) END""",
)
def _(s, d):
    last = table(s, d, "kv_incoming").where("octet_length(user_key) > 0").groupBy("user_key").agg(F.max("incoming_id").alias("id"))
    meta = F.when(F.col("id") % 5 == 0, F.lit(S.DELETE)).otherwise(F.lit(0)).cast("smallint")
    pending = last.select("user_key", F.lit(S.MAX_VERSION).alias("version"), F.encode(F.col("id").cast("string"), "UTF-8").alias("value"), F.lit(0).cast("bigint").alias("expires_at"), F.lit(0).cast("smallint").alias("user_meta"), meta.alias("meta"), F.lit(None).cast(S.VPTR).alias("vptr"))
    return _shown(overlay(pending, snapshot.newest(A.records(s, d), arrival="arrival").select(*S.KV_COLUMNS)).where(~S.gone(NOW)))


def _retention_sql(keep: int, overlap: bool, prefixes: tuple[str, ...], pick: str) -> str:
    under = " OR ".join(f"starts_with(hex(user_key), hex('{p}'::BLOB))" for p in prefixes) or "false"
    return f"""WITH {KV}, a AS (SELECT *, {under} AS under, (version <= 15000 AND meta & 8 = 0)::INT AS elig, {GONE} AS gone, meta & 4 <> 0 AS mark FROM kv),
  b AS (SELECT *, sum(elig) OVER w AS n, first(mark) OVER w AS top FROM a WHERE NOT under WINDOW w AS (PARTITION BY user_key ORDER BY version DESC ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT *, elig = 1 AND (gone OR mark OR n = {keep}) AS stop FROM b),
  e AS (SELECT *, coalesce(max(stop::INT) OVER (PARTITION BY user_key ORDER BY version DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after FROM c),
  f AS (SELECT *, after OR (stop AND gone AND NOT {str(overlap).lower()}) AS dropped FROM e),
  g AS (SELECT user_key, version, value, meta, vptr, dropped, NOT dropped AND (top OR gone) AS stale FROM f UNION ALL SELECT user_key, version, value, meta, vptr, true, false FROM a WHERE under)
  SELECT {pick}"""


_PICK = "hex(user_key) AS user_key, version, stale FROM g WHERE NOT dropped"


def _judged(s, d, keep=1, overlap=False, prefixes=()):
    return retention.judged(A.kv(s, d), NOW, 15_000, keep, overlap, [p.encode() for p in prefixes])


def _kept(j):
    return j.where(~F.col("dropped")).select(_key(), "version", "stale")


@query("q15_retention_kept", _retention_sql(1, False, (), _PICK))
def _(s, d):
    return _kept(_judged(s, d))


@query("q16_retention_dropped", _retention_sql(1, False, (), "hex(user_key) AS user_key, version FROM g WHERE dropped"))
def _(s, d):
    return _judged(s, d).where("dropped").select(_key(), "version")


@query("q17_retention_keep3", _retention_sql(3, False, (), _PICK))
def _(s, d):
    return _kept(_judged(s, d, keep=3))


@query("q18_retention_overlap", _retention_sql(1, True, (), _PICK))
def _(s, d):
    return _kept(_judged(s, d, overlap=True))


@query("q19_drop_prefix", _retention_sql(2, False, ("gauge:", "sess-4"), _PICK))
def _(s, d):
    return _kept(_judged(s, d, keep=2, prefixes=("gauge:", "sess-4")))


@query("q20_discard_stats", _retention_sql(1, False, (), "CAST(vptr.fid AS BIGINT) AS fid, CAST(sum(vptr.len) AS BIGINT) AS bytes FROM g WHERE dropped AND meta & 2 <> 0 AND vptr IS NOT NULL GROUP BY vptr.fid"))
def _(s, d):
    return retention.discard_stats(_judged(s, d))


@query("q20b_discard_accumulate", """
SELECT CAST(fid AS BIGINT) AS fid, CASE WHEN min(n) < 0 THEN 0 ELSE CAST(sum(n) AS BIGINT) END AS bytes FROM
(SELECT fid, CASE WHEN coalesce(value_len, 0) < 0 AND fid % 3 = 0 THEN -1 ELSE greatest(coalesce(value_len, 0), 0) END AS n FROM (SELECT DISTINCT * FROM vlog_entry)) GROUP BY fid""".replace("SELECT DISTINCT *", "SELECT DISTINCT fid, entry_pos, value_len"))  # fmt: skip
def _(s, d):
    n = F.coalesce("value_len", F.lit(0))
    changes = table(s, d, "vlog_entry").select("fid", "entry_pos", "value_len").distinct().select(F.col("fid").cast("bigint").alias("fid"), F.when((n < 0) & (F.col("fid") % 3 == 0), -1).otherwise(F.greatest(n, F.lit(0))).cast("bigint").alias("n"))
    return retention.accumulate_discards(changes.limit(0).select("fid", F.col("n").alias("bytes")), changes)


@query(
    "q20c_discard_onto_stats",
    """WITH c AS (SELECT CAST(fid AS BIGINT) AS fid, entry_pos, CASE WHEN entry_pos % 11 = 0 THEN -1 ELSE coalesce(greatest(value_len, 0), 0) END AS n FROM (SELECT DISTINCT fid, entry_pos, value_len FROM vlog_entry) WHERE fid % 2 = 0),
  b AS (SELECT CAST(fid AS BIGINT) AS fid, CAST(1000 + fid AS BIGINT) AS bytes FROM (SELECT DISTINCT fid FROM vlog_entry)),
  l AS (SELECT fid, max(entry_pos) AS last FROM c WHERE n < 0 GROUP BY fid)
  SELECT b.fid, CAST(CASE WHEN l.last IS NULL THEN b.bytes ELSE 0 END + coalesce((SELECT sum(n) FROM c WHERE c.fid = b.fid AND (l.last IS NULL OR c.entry_pos > l.last)), 0) AS BIGINT) AS bytes FROM b LEFT JOIN l USING (fid)""",
)
def _(s, d):
    log = table(s, d, "vlog_entry").select(F.col("fid").cast("bigint").alias("fid"), "entry_pos", "value_len").distinct()
    n = F.when(F.col("entry_pos") % 11 == 0, -1).otherwise(F.coalesce(F.greatest("value_len", F.lit(0)), F.lit(0))).cast("bigint")
    base = log.select("fid").distinct().withColumn("bytes", (1000 + F.col("fid")).cast("bigint"))
    return retention.accumulate_discards(base, log.where("fid % 2 = 0").select("fid", "entry_pos", n.alias("n")), "entry_pos")


@query("q21_stale_size", _retention_sql(3, True, (), "count(*) AS n_stale, CAST(coalesce(sum(octet_length(user_key) + coalesce(octet_length(value), 0) + 12), 0) AS BIGINT) AS stale_bytes FROM g WHERE stale"))
def _(s, d):
    return retention.stale_size(_judged(s, d, keep=3, overlap=True))


@query(
    "q22_table_stats",
    f"""WITH {KV} SELECT stream_id, hex(min(user_key)) AS smallest, hex(max(user_key)) AS biggest, count(*) AS key_count, max(version) AS max_version,
  CAST(sum(octet_length(user_key) + coalesce(octet_length(value), 0) + 12) AS BIGINT) AS uncompressed_size FROM kv GROUP BY stream_id""",
)
def _(s, d):
    rows = snapshot.last_written(A.records(s, d), "arrival")
    return tables.table_stats(rows, ["stream_id"]).withColumns({c: F.hex(c) for c in ("smallest", "biggest")})


_TABLES = "tables AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY listed_at DESC NULLS LAST, listing_id DESC) AS rn FROM table_info) WHERE rn = 1)"


@query(
    "q23_level_validate",
    f"""WITH {_TABLES} SELECT table_id, level FROM (SELECT *, max(biggest) OVER (PARTITION BY level ORDER BY smallest, table_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM tables WHERE level >= 1 AND smallest IS NOT NULL AND biggest IS NOT NULL) WHERE before >= smallest""",
)
def _(s, d):
    return tables.level_violations(A.current_tables(s, d)).select("table_id", "level")


@query(
    "q24_overlap_counts",
    f"""WITH {_TABLES} SELECT a.level, a.table_id, count(b.table_id) AS n_overlaps, CAST(coalesce(sum(b.on_disk_size), 0) AS BIGINT) AS overlap_bytes FROM tables a LEFT JOIN tables b
  ON b.level = a.level + 1 AND a.smallest <= b.biggest AND b.smallest <= a.biggest WHERE a.smallest IS NOT NULL AND a.biggest IS NOT NULL AND a.level IS NOT NULL GROUP BY a.level, a.table_id""",
)
def _(s, d):
    return tables.overlap_counts(A.current_tables(s, d))


@query("q25_range_union", f"WITH {_TABLES} SELECT level, hex(min(smallest)) AS \"left\", hex(max(biggest)) AS \"right\", false AS inf FROM tables GROUP BY level")
def _(s, d):
    return tables.range_union(A.current_tables(s, d), ["level"]).withColumns({"left": F.hex("left"), "right": F.hex("right")})


@query("q25b_table_listing", f"WITH {_TABLES} SELECT table_id, level, hex(smallest) AS smallest, hex(biggest) AS biggest, key_count, max_version FROM tables")
def _(s, d):
    return tables.listing(A.current_tables(s, d)).select("table_id", "level", F.hex("smallest").alias("smallest"), F.hex("biggest").alias("biggest"), "key_count", "max_version")


@query("q26_level_scores", f"""WITH {_TABLES}, z AS (SELECT level, CAST(coalesce(sum(greatest(on_disk_size, 0)), 0) AS BIGINT) AS b, count(*) AS n FROM tables GROUP BY level)
  SELECT CAST(l AS INT) AS level, coalesce(b, 0) AS n_bytes, coalesce(n, 0) AS n_tables FROM range(6) r(l) LEFT JOIN z ON z.level = r.l""")  # fmt: skip
def _(s, d):
    t = A.current_tables(s, d).withColumn("on_disk_size", F.greatest("on_disk_size", F.lit(0)))
    return levels.planned(s, t).select("level", "n_bytes", "n_tables")


@query(
    "q27_level_targets",
    f"""WITH {_TABLES}, z AS (SELECT CAST(l AS INT) AS level, CAST(coalesce(sum(greatest(on_disk_size, 0)), 0) AS BIGINT) AS n_bytes, count(table_id) AS n_tables
    FROM range(6) r(l) LEFT JOIN tables ON tables.level = r.l GROUP BY l),
  w AS (SELECT *, (SELECT n_bytes FROM z WHERE level = 5) // CAST(10 ** (5 - level) AS BIGINT) AS want FROM z),
  t AS (SELECT *, CASE WHEN level = 0 THEN 0 ELSE greatest(want, 10485760) END AS target_size,
    (SELECT coalesce(max(level), 0) FROM w WHERE level > 0 AND want <= 10485760) AS base0 FROM w),
  f AS (SELECT *, CASE WHEN level = 0 THEN 67108864 ELSE 2097152 * CAST(2 ** greatest(0, level - base0) AS BIGINT) END AS file_size,
    greatest(base0, (SELECT coalesce(min(level), 6) FROM t x WHERE x.n_bytes > 0 AND x.level >= x.base0) - 1) AS base1 FROM t),
  g AS (SELECT *, base1 + CASE WHEN (SELECT bool_and(n_bytes = 0) FROM f x WHERE x.level = x.base1 AND x.base1 < 5)
    AND (SELECT bool_and(n_bytes < target_size) FROM f x WHERE x.level = x.base1 + 1) THEN 1 ELSE 0 END AS base FROM f),
  s AS (SELECT *, CASE WHEN level = 0 THEN n_tables / 5.0 ELSE n_bytes / target_size END AS score FROM g),
  a AS (SELECT s.*, x.score AS below FROM s LEFT JOIN s x ON x.level = CASE WHEN s.level = 0 THEN s.base WHEN s.level >= s.base THEN s.level + 1 END)
  SELECT level, n_bytes, n_tables, CAST(target_size AS BIGINT) AS target_size, CAST(file_size AS BIGINT) AS file_size, level = base AS is_base,
    CASE WHEN level < 5 AND score >= 1 THEN CAST(score AS DOUBLE) END AS score,
    CASE WHEN level < 5 AND score >= 1 THEN CAST(CASE WHEN below IS NULL THEN score ELSE score / greatest(below, 0.01) END AS DOUBLE) END AS adjusted FROM a""",
)
def _(s, d):
    t = A.current_tables(s, d).withColumn("on_disk_size", F.greatest("on_disk_size", F.lit(0)))
    return levels.planned(s, t)


_DOCS = "d AS (SELECT doc_id, text, strlen(text) AS n FROM documents WHERE text IS NOT NULL)"


def _doc_records(s, d):
    key = S.be64(F.col("doc_id"))
    return table(s, d, "documents").where("text IS NOT NULL").select(
        key.alias("user_key"), F.lit(1).cast("bigint").alias("version"), F.encode("text", "UTF-8").alias("value"), F.lit(0).cast("bigint").alias("expires_at"),
        F.lit(0).cast("smallint").alias("user_meta"), F.lit(S.TXN).cast("smallint").alias("meta"), F.lit(None).cast(S.VPTR).alias("vptr"),
    )


@query(
    "q28_value_separation",
    f"""WITH {_DOCS}, l AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM d WHERE n >= 1024)
  SELECT lpad(to_hex(d.doc_id), 16, '0') AS user_key, CASE WHEN l.n IS NULL THEN 64 ELSE 66 END AS meta, CAST(l.line // 1048576 AS BIGINT) AS fid, CAST(l.line % 1048576 AS BIGINT) AS "offset", CAST(l.n AS BIGINT) AS len
  FROM d LEFT JOIN l USING (doc_id)""",
)
def _(s, d):
    kv, _log = values.separated(_doc_records(s, d), 1024, 1 << 20, ["user_key"])
    return kv.select(_key(), F.col("meta").cast("int").alias("meta"), *[F.col(f"vptr.{c}").cast("bigint").alias(c) for c in ("fid", "offset", "len")])


@query("q29_pointer_resolve", f"WITH {_DOCS} SELECT lpad(to_hex(doc_id), 16, '0') AS user_key, md5(text) AS md5 FROM d")
def _(s, d):
    kv, log = values.separated(_doc_records(s, d), 1024, 1 << 20, ["user_key"])
    return values.resolved(kv, log).select(_key(), F.md5("value").alias("md5"))


@query("q29b_value_log_reclaim", """WITH v AS (SELECT DISTINCT fid, entry_pos, value_len FROM vlog_entry), k AS (SELECT DISTINCT vptr.fid AS fid, vptr.pos AS entry_pos FROM kv_record WHERE meta & 2 <> 0 AND vptr IS NOT NULL)
  SELECT fid, entry_pos, value_len FROM v SEMI JOIN k USING (fid, entry_pos)""")  # fmt: skip
def _(s, d):
    log = table(s, d, "vlog_entry").select("fid", F.col("entry_pos").alias("offset"), "value_len").distinct()
    return values.reclaim(log, A.records(s, d)).withColumnRenamed("offset", "entry_pos").select("fid", "entry_pos", "value_len")


_LOG = "v AS (SELECT DISTINCT fid, entry_pos, value_len FROM vlog_entry WHERE value_len >= 0)"


@query("q30_log_histogram", f"WITH {_LOG} SELECT fid, CAST(floor(100 * ln(1 + value_len) + 0.5) AS INT) AS bucket, count(*) AS n, CAST(sum(value_len) AS BIGINT) AS total FROM v GROUP BY 1, 2")
def _(s, d):
    return sketches.log_histogram(A.log_entries(s, d).where("value_len >= 0"), "value_len", ["fid"])


@query(
    "q31_log_histogram_percentiles",
    f"""WITH {_LOG}, h AS (SELECT fid, CAST(floor(100 * ln(1 + value_len) + 0.5) AS INT) AS bucket, count(*) AS n FROM v GROUP BY 1, 2),
  c AS (SELECT *, sum(n) OVER (PARTITION BY fid ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY fid) AS total FROM h)
  SELECT fid, CAST(pct AS DOUBLE) AS pct, min(bucket) AS bucket, round(exp(min(bucket) / 100.0) - 1, 6) AS value FROM c, (VALUES (0),(50),(75),(90),(95),(97.5),(99),(99.9),(99.99),(100)) p(pct)
  WHERE upto >= CASE WHEN pct = 0 THEN 1 ELSE CAST(total AS DOUBLE) * CAST(pct AS DOUBLE) / 100 END GROUP BY fid, pct""",
)
def _(s, d):
    h = sketches.log_histogram(A.log_entries(s, d).where("value_len >= 0"), "value_len", ["fid"])
    p = sketches.histogram_percentile(h, [0, 50, 75, 90, 95, 97.5, 99, 99.9, 99.99, 100], ["fid"])
    return p.select("fid", "pct", "bucket", F.round("value", 6).alias("value"))


@query("q31b_dynamic_threshold", f"""WITH {_LOG}, h AS (SELECT CAST(floor(100 * ln(1 + value_len) + 0.5) AS INT) AS bucket, count(*) AS n FROM v GROUP BY 1),
  c AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM h) SELECT least(greatest(CAST(round(exp(min(bucket) / 100.0) - 1) AS BIGINT), 64), 1048576) AS threshold FROM c WHERE upto >= total * 0.9""")  # fmt: skip
def _(s, d):
    return values.dynamic_threshold(A.log_entries(s, d).where("value_len >= 0"), "value_len", 0.9, 64, 1 << 20)


_TXN = """r AS (SELECT l_orderkey AS txn_id, l_partkey AS key, greatest(l_orderkey - l_orderkey % 50, 0) AS read_ts, l_orderkey + 1 AS commit_ts FROM lineitem WHERE l_linestatus = 'O'),
  w AS (SELECT DISTINCT l_orderkey + 1 AS commit_ts, l_partkey AS key FROM lineitem WHERE l_returnflag <> 'R')"""


@query(
    "q32_conflict_candidates",
    f"""WITH {_TXN} SELECT txn_id, count(DISTINCT r.key) AS n_keys, min(w.commit_ts) AS first_ts FROM r JOIN w ON w.key = r.key AND w.commit_ts > r.read_ts AND w.commit_ts < r.commit_ts GROUP BY txn_id""",
)
def _(s, d):
    return txns.conflict_candidates(A.txn_reads(s, d), A.txn_writes(s, d))


@query(
    "q33_conflicts_resolved",
    f"""WITH RECURSIVE {_TXN}, t AS (SELECT o // 50 AS block, o % 50 AS place, list(DISTINCT r.key) FILTER (WHERE r.key IS NOT NULL) AS reads,
    list(DISTINCT w.key) FILTER (WHERE w.key IS NOT NULL) AS writes FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem) LEFT JOIN r ON r.txn_id = o LEFT JOIN w ON w.commit_ts = o + 1 GROUP BY o),
  s AS (SELECT DISTINCT block, CAST(-1 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS held, false AS refused FROM t
    UNION ALL SELECT s.block, s.place + 1, CASE WHEN coalesce(list_has_any(held, reads), false) THEN held ELSE list_concat(held, coalesce(writes, [])) END, coalesce(list_has_any(held, reads), false)
    FROM s LEFT JOIN t ON t.block = s.block AND t.place = s.place + 1 WHERE s.place < 49)
  SELECT block * 50 + place AS txn_id, block * 50 + place + 1 AS commit_ts FROM s WHERE refused""",
)
def _(s, d):
    return txns.conflicts_resolved(A.txn_reads(s, d), A.txn_writes(s, d))


_MARKS = "m AS (SELECT o_orderkey AS ts, false AS done FROM orders UNION ALL SELECT o_orderkey, true FROM orders WHERE o_orderkey % 997 <> 996)"


@query(
    "q34_watermark",
    f"""WITH {_MARKS}, o AS (SELECT ts, count(*) FILTER (WHERE NOT done) > count(*) FILTER (WHERE done) AS open FROM m GROUP BY ts)
  SELECT coalesce(max(ts), 0) AS done_until FROM o WHERE ts < (SELECT coalesce(min(ts), 9223372036854775807) FROM o WHERE open)""",
)
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("ts"))
    return txns.watermark(o.withColumn("done", F.lit(False)).unionByName(o.where("ts % 997 <> 996").withColumn("done", F.lit(True))))


@query(
    "q35_batch_recovery",
    """WITH l AS (SELECT l_orderkey // 1000 AS fid, l_orderkey * 10 + l_linenumber AS pos, l_orderkey AS txn_ts, false AS fin, l_partkey AS key FROM lineitem
    UNION ALL SELECT o_orderkey // 1000, o_orderkey * 10 + 9, o_orderkey, true, NULL FROM orders WHERE o_orderkey % 100 <> 37),
  b AS (SELECT fid, txn_ts, min(pos) AS start, bool_or(fin) AS whole FROM l GROUP BY 1, 2), k AS (SELECT fid, min(start) AS stop FROM b WHERE NOT whole GROUP BY fid)
  SELECT l.fid, pos, txn_ts, key FROM l LEFT JOIN k ON k.fid = l.fid WHERE NOT fin AND (stop IS NULL OR pos < stop)""",
)
def _(s, d):
    return txns.recovered(A.log_records(s, d)).select("fid", "pos", "txn_ts", "key")


@query("q35b_prune_committed", f"WITH {_TXN} SELECT commit_ts, key FROM w WHERE commit_ts > 1000")
def _(s, d):
    return txns.pruned(A.txn_writes(s, d).distinct(), 1000)


@query("q35c_commit_order", "SELECT incoming_id, row_number() OVER (ORDER BY incoming_id) AS commit_ts FROM kv_incoming")
def _(s, d):
    return txns.commit_order(table(s, d, "kv_incoming").select("incoming_id"), "incoming_id")


@query(
    "q36_write_validation",
    """SELECT incoming_id, CASE WHEN user_key IS NULL OR octet_length(user_key) = 0 THEN 'EmptyKey' WHEN starts_with(hex(user_key), hex('!sys!'::BLOB)) OR octet_length(user_key) > 65000 THEN 'InvalidKey'
  WHEN octet_length(user_key) > 30 THEN 'ValueLogSize' WHEN octet_length(user_key) > 8 AND substr(hex(user_key), 1, 16) IN ('00000000000003F7', '00000000000003FA') THEN 'BannedKey' END AS error FROM kv_incoming""",
)
def _(s, d):
    rows = table(s, d, "kv_incoming").withColumn("value", F.col("user_key"))
    return rows.select("incoming_id", S.write_error(30, [0x3F7, 0x3FA], 0).alias("error"))


@query(
    "q37_txn_size_check",
    f"""WITH {KV}, z AS (SELECT version AS txn_id, count(*) AS n_entries, CAST(sum(10 + CASE WHEN coalesce(octet_length(value), 0) < 32 THEN octet_length(user_key) + coalesce(octet_length(value), 0) + 2 ELSE octet_length(user_key) + 14 END) AS BIGINT) AS n_bytes FROM kv GROUP BY version)
  SELECT *, n_entries >= 4 OR n_bytes >= 200 AS too_big FROM z""",
)
def _(s, d):
    entries = A.kv(s, d).select(F.col("version").alias("txn_id"), S.entry_size(32).alias("n_bytes"))
    return txns.batch_sizes(entries, 4, 200)


@query("q38_namespace_ban", f"WITH {KV} SELECT hex(user_key) AS user_key, version FROM kv WHERE NOT (octet_length(user_key) > 8 AND substr(hex(user_key), 1, 16) IN ('00000000000003F7', '00000000000003FA'))")
def _(s, d):
    return A.kv(s, d).where(~F.coalesce(S.namespace(0).isin(0x3F7, 0x3FA), F.lit(False))).select(_key(), "version")


SUBSCRIPTIONS = [Subscription(1, b"sess-"), Subscription(2, b"ctr/"), Subscription(3, b"ctr/grove"), Subscription(4, b""), Subscription(5, b"gauge:00000000", "6-13"), Subscription(6, b"?tr/", "0"), Subscription(7, b"map/\xc3\xaele/seg", "4, 5")]

_MATCH = " UNION ALL ".join(
    f"SELECT {i} AS subscription, user_key, version FROM kv WHERE {p}"
    for i, p in (
        (1, "starts_with(hex(user_key), hex('sess-'::BLOB))"), (2, "starts_with(hex(user_key), hex('ctr/'::BLOB))"), (3, "starts_with(hex(user_key), hex('ctr/grove'::BLOB))"), (4, "true"),
        (5, "octet_length(user_key) >= 14 AND starts_with(hex(user_key), hex('gauge:'::BLOB))"), (6, "octet_length(user_key) >= 4 AND substr(hex(user_key), 3, 6) = hex('tr/'::BLOB)"),
        (7, "octet_length(user_key) >= 12 AND starts_with(hex(user_key), hex('map/'::BLOB)) AND substr(hex(user_key), 13, 12) = hex('le/seg'::BLOB)"),
    )
)
_MATCHED = f"WITH {KV}, m AS ({_MATCH}) SELECT CAST(subscription AS BIGINT) AS subscription, hex(user_key) AS user_key, version FROM m WHERE NOT starts_with(hex(user_key), hex('!sys!'::BLOB))"


@query("q39_subscribe_match", _MATCHED + " AND subscription <= 4")
def _(s, d):
    return published(A.kv(s, d), SUBSCRIPTIONS[:4]).select("subscription", _key(), "version")


@query("q40_subscribe_wildcard", _MATCHED + " AND subscription > 4")
def _(s, d):
    return published(A.kv(s, d), SUBSCRIPTIONS[4:]).select("subscription", _key(), "version")


@query("q41_ignore_parse", "SELECT * FROM (VALUES ('0 , 3 - 5 ,7 ', '10011101'), ('0', '1'), ('1', '01'), ('', '')) t(text, mask)")
def _(s, d):
    texts = ["0 , 3 - 5 ,7 ", "0", "1", ""]
    return s.createDataFrame([(t, "".join("01"[b] for b in parse_ignore(t))) for t in texts], "text string, mask string")


@query("q42_bloom_probe", "SELECT count(*) AS n_keys, count(DISTINCT stream_id) AS n_streams, 0 AS missed FROM (SELECT DISTINCT stream_id, user_key FROM kv_record WHERE stream_id IS NOT NULL)")
def _(s, d):
    """Keys that their own filter denies: none.  A filter holds a bounded part of a stream's keys."""
    keys = table(s, d, "kv_record").where("stream_id IS NOT NULL").select("stream_id", "user_key").distinct()
    keys = sketches.bounded_groups(keys, "user_key", "part")
    has = sketches.bloom_probe(keys, sketches.bloom_filters(keys, ["stream_id", "part"], "user_key"), ["stream_id", "part"], "user_key")
    return has.agg(F.count(F.lit(1)).alias("n_keys"), F.countDistinct("stream_id").alias("n_streams"), F.sum((~F.col("has")).cast("int")).cast("int").alias("missed"))


@query(
    "q43_bloom_hash",
    """WITH k AS (SELECT DISTINCT user_key, hex(user_key) AS x, octet_length(user_key) AS n FROM kv_record),
  b AS (SELECT *, list_transform(range(0, n), lambda i: CAST(('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2)) AS HUGEINT)) AS bytes FROM k),
  w AS (SELECT *, list_prepend(xor(CAST(3164544308 AS HUGEINT), (n * CAST(3332679571 AS HUGEINT)) % 4294967296),
    list_transform(range(0, n // 4), lambda i: bytes[4 * i + 1] + 256 * bytes[4 * i + 2] + 65536 * bytes[4 * i + 3] + 16777216 * bytes[4 * i + 4])) AS words FROM b),
  h AS (SELECT *, list_reduce(words, lambda h, v: xor((h + v) * 3332679571 % 4294967296, ((h + v) * 3332679571 % 4294967296) // 65536)) AS h FROM w),
  r AS (SELECT *, CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN bytes[n] WHEN 2 THEN bytes[n - 1] + 256 * bytes[n] ELSE bytes[n - 2] + 256 * bytes[n - 1] + 65536 * bytes[n] END AS rest FROM h)
  SELECT x AS user_key, CAST(CASE WHEN rest IS NULL THEN h ELSE xor((h + rest) * 3332679571 % 4294967296, ((h + rest) * 3332679571 % 4294967296) // 16777216) END AS BIGINT) AS hash FROM r""",
)
def _(s, d):
    return table(s, d, "kv_record").select("user_key").distinct().select(_key(), sketches.bloom_hash_udf("user_key").alias("hash"))


@query("q44_checksum_verify", f"WITH {KV} SELECT count(*) AS n, 0 AS n_corrupt FROM kv WHERE value IS NOT NULL")
def _(s, d):
    checked = integrity.with_checksum(A.kv(s, d).where("value IS NOT NULL"), "value")
    bad = ~integrity.checksum(F.col("value")).eqNullSafe(F.col("checksum"))
    return checked.agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("int")).cast("int").alias("n_corrupt"))


@query("q44b_corrupt_found", f"WITH {KV} SELECT hex(user_key) AS user_key, version FROM kv WHERE value IS NOT NULL AND version % 97 = 0")
def _(s, d):
    """Values that get one more byte, or lose one, after their checksum was taken."""
    checked = integrity.with_checksum(A.kv(s, d).where("value IS NOT NULL"), "value")
    shorter = F.when(F.octet_length("value") > 1, F.expr("substring(value, 2, octet_length(value))"))
    harmed = F.when(F.col("version") % 2 == 0, shorter)
    harmed = F.coalesce(harmed, F.concat(F.col("value"), F.lit(bytearray(b"x")).cast("binary")))
    spoilt = checked.withColumn("value", F.when(F.col("version") % 97 == 0, harmed).otherwise(F.col("value")))
    return integrity.corrupt(spoilt, "value").select(_key(), "version")


@query("q45_encrypt_roundtrip", f"WITH {KV} SELECT {SHOW} FROM kv")
def _(s, d):
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    sealed = A.kv(s, d).withColumn("value", integrity.encrypted(F.col("value"), key))
    return _shown(sealed.withColumn("value", integrity.decrypted(F.col("value"), key)))


@query("q45b_encrypted_bytes", f"WITH {KV} SELECT count(*) AS n, 0 AS n_same, 28 * count(*) AS overhead FROM kv WHERE value IS NOT NULL")
def _(s, d):
    """Sealed values differ from plain ones and are longer by a nonce and a tag."""
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    sealed = A.kv(s, d).where("value IS NOT NULL").withColumn("sealed", integrity.encrypted(F.col("value"), key))
    more = F.octet_length("sealed") - F.octet_length("value")
    same = F.expr("sealed = value OR (octet_length(value) > 8 AND contains(sealed, value))")
    return sealed.agg(F.count(F.lit(1)).alias("n"), F.sum(same.cast("int")).cast("int").alias("n_same"), F.sum(more.cast("bigint")).alias("overhead"))


@query("q46b_codecs_of_files", "SELECT * FROM (VALUES (0, 'UNCOMPRESSED'), (1, 'SNAPPY'), (2, 'ZSTD')) t(code, codec)")
def _(s, d):
    """What the footers of written files say of each codec."""
    found = None
    for code in (0, 1, 2):
        at = shared_path(s, "codec")
        integrity.written_with(A.kv(s, d), code, at, "user_key")
        one = integrity.codecs_of(s, at).select(F.lit(code).alias("code"), "codec")
        found = one if found is None else found.unionByName(one)
    return found


for _code in (0, 1, 2):

    @query(f"q46_compression_roundtrip_{integrity.CODECS[_code]}", f"WITH {KV} SELECT {SHOW} FROM kv")
    def _(s, d, code: int = _code):
        return _shown(integrity.written_with(A.kv(s, d), code, shared_path(s, "codec"), "user_key"))


_STATE = """state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY seq DESC) AS rn FROM manifest_changes) WHERE rn = 1 AND upper(trim(op)) IN ('CREATE', '0'))"""


@query("q47_manifest_replay", f"WITH {_STATE} SELECT table_id, level, key_id, compression FROM state")
def _(s, d):
    return tables.manifest_state(table(s, d, "manifest_changes")).drop("seq")


@query(
    "q47b_manifest_errors",
    """WITH o AS (SELECT DISTINCT table_id, seq, CASE WHEN upper(trim(op)) IN ('CREATE', '0') THEN 'C' ELSE 'D' END AS op, CASE WHEN upper(trim(op)) IN ('CREATE', '0') THEN level END AS level FROM manifest_changes),
  w AS (SELECT *, lag(op) OVER x AS was, lag(level) OVER x AS was_level FROM o WINDOW x AS (PARTITION BY table_id ORDER BY seq))
  SELECT table_id, seq, CASE WHEN op = 'D' AND was IS DISTINCT FROM 'C' THEN 'unknown delete' ELSE 'repeated create' END AS error FROM w WHERE (op = 'D' AND was IS DISTINCT FROM 'C') OR (op = 'C' AND was = 'C' AND was_level IS NOT DISTINCT FROM level)""",
)
def _(s, d):
    return tables.manifest_errors(table(s, d, "manifest_changes"))


@query(
    "q47c_manifest_rewrite",
    f"""WITH {_STATE}, o AS (SELECT DISTINCT table_id, seq, upper(trim(op)) IN ('CREATE', '0') AS c FROM manifest_changes)
  SELECT CAST(sum(c::INT) AS BIGINT) AS creations, CAST(sum((NOT c)::INT) AS BIGINT) AS deletions, (SELECT count(*) FROM state) AS live, sum((NOT c)::INT) > 10000 AND sum((NOT c)::INT) > 10 * (SELECT count(*) FROM state) AS rewrite FROM o""",
)
def _(s, d):
    return tables.manifest_rewrite_due(table(s, d, "manifest_changes"))


@query(
    "q48_revert_to_manifest",
    f"""WITH {_STATE}, f AS (SELECT DISTINCT table_id FROM table_info) SELECT table_id, 'extra' AS side FROM f WHERE table_id NOT IN (SELECT table_id FROM state)
  UNION ALL SELECT table_id, 'missing' FROM state WHERE table_id NOT IN (SELECT table_id FROM f)""",
)
def _(s, d):
    return tables.revert(table(s, d, "table_info").where("table_id IS NOT NULL").select("table_id"), table(s, d, "manifest_changes"))


@query("q49_key_prefix_overlap", """WITH k AS (SELECT DISTINCT hex(user_key) AS h, substr(hex(user_key), 1, 6) AS block FROM kv_record), f AS (SELECT block, min(h) AS first FROM k GROUP BY block)
  SELECT block, h AS user_key, CAST(coalesce(list_min(list_filter(range(1, least(len(h), len(first)) // 2 + 1), lambda i: substr(h, CAST(i * 2 - 1 AS BIGINT), 2) <> substr(first, CAST(i * 2 - 1 AS BIGINT), 2))) - 1, least(len(h), len(first)) // 2) AS INT) AS shared FROM k JOIN f USING (block)""")  # fmt: skip
def _(s, d):
    keys = table(s, d, "kv_record").select("user_key").distinct()
    return tables.prefix_overlap(keys.withColumn("block", F.substring(F.hex("user_key"), 1, 6)), ["block"]).select("block", _key(), "shared")


@query("q49b_codec_roundtrip", f"WITH {KV} SELECT {SHOW}, CAST(user_meta AS INT) AS user_meta, CAST(meta AS INT) AS meta, expires_at FROM kv WHERE value IS NOT NULL")
def _(s, d):
    packed = A.kv(s, d).where("value IS NOT NULL").select(codecs.encode_key("user_key", "version").alias("k"), codecs.encode_value(F.col("user_meta"), F.col("meta"), F.col("expires_at"), F.col("value")).alias("v"))
    read = packed.select(codecs.decode_key("k").alias("k"), codecs.decode_value("v").alias("v"))
    return read.select(F.hex("k.user_key").alias("user_key"), "k.version", F.hex("v.value").alias("value"), "v.user_meta", "v.meta", "v.expires_at")


@query("q50_cdc_stream", f"WITH m AS ({_MATCH.replace('FROM kv ', 'FROM kv_record ')}) SELECT CAST(subscription AS BIGINT) AS subscription, count(*) AS n_events FROM m WHERE NOT starts_with(hex(user_key), hex('!sys!'::BLOB)) GROUP BY subscription")
def _(s, d):
    out = shared_path(s, "events")
    stream = stream_table(s, d, "kv_record")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")  # the same again if it comes again

    done = subscribe(stream, SUBSCRIPTIONS, write, shared_path(s, "offsets"), once=True)
    done.awaitTermination()
    return s.read.parquet(out).groupBy("subscription").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    "q51_metrics",
    f"""WITH {KV} SELECT count(*) AS n_puts, count(DISTINCT user_key) AS n_keys, CAST(sum(octet_length(user_key) + coalesce(octet_length(value), 0)) AS BIGINT) AS user_bytes,
  count(*) FILTER (WHERE meta & 1 <> 0) AS n_deletes, CAST(coalesce(sum(vptr.len) FILTER (WHERE meta & 2 <> 0), 0) AS BIGINT) AS value_log_bytes FROM kv""",
)
def _(s, d):
    n = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return A.kv(s, d).agg(
        F.count(F.lit(1)).alias("n_puts"), F.countDistinct("user_key").alias("n_keys"), F.sum(n.cast("bigint")).alias("user_bytes"), F.sum(S.deleted().cast("bigint")).alias("n_deletes"),
        F.coalesce(F.sum(F.when(S.has(S.VALUE_POINTER), F.col("vptr.len").cast("bigint"))), F.lit(0)).alias("value_log_bytes"),
    )


@query("q52_event_snapshot", f"""WITH e AS (SELECT user_id, event_id + 1 AS version, props, event_type, CASE WHEN event_type = 'click' THEN epoch_us(ts) // 1000000 + 86400 * (1 + event_id % 30) ELSE 0 END AS expires_at FROM events WHERE user_id IS NOT NULL),
  c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC) AS rk FROM e) SELECT 'user/' || user_id AS user_key, version, props AS value FROM c
  WHERE rk = 1 AND event_type <> 'error' AND NOT (expires_at <> 0 AND expires_at <= {A.EVENTS_NOW})""")  # fmt: skip
def _(s, d):
    return snapshot.snapshot(A.event_records(s, d), A.EVENTS_NOW).select(F.decode("user_key", "UTF-8").alias("user_key"), "version", F.decode("value", "UTF-8").alias("value"))


@query("q53_set_difference", "SELECT hex(user_key) AS user_key, 'extra' AS side FROM (SELECT DISTINCT user_key FROM kv_incoming WHERE user_key IS NOT NULL) i WHERE NOT EXISTS (SELECT 1 FROM kv_record k WHERE k.user_key = i.user_key) UNION ALL SELECT hex(user_key), 'missing' FROM (SELECT DISTINCT user_key FROM kv_record) k WHERE NOT EXISTS (SELECT 1 FROM kv_incoming i WHERE i.user_key = k.user_key)")
def _(s, d):
    return differences(table(s, d, "kv_incoming").where("user_key IS NOT NULL"), table(s, d, "kv_record"), "user_key").select(_key(), "side")


@query(
    "q54_merge_entries",
    f"""WITH {KV}, r AS (SELECT *, max(version) FILTER (WHERE meta & 8 = 0) OVER (PARTITION BY user_key) AS base FROM kv WHERE {REAL}),
  x AS (SELECT * FROM r WHERE version > coalesce(base, -1) OR (version = base AND NOT {GONE}))
  SELECT hex(user_key) AS user_key, count(*) AS n_merged, max(version) AS version, CAST(coalesce(sum(octet_length(value)), 0) AS BIGINT) AS n_bytes FROM x GROUP BY x.user_key""",
)
def _(s, d):
    totals = [F.count(F.lit(1)).alias("n_merged"), F.max("version").alias("version"), F.coalesce(F.sum(F.octet_length("value").cast("bigint")), F.lit(0)).alias("n_bytes")]
    return merge_entries(A.kv(s, d), NOW, totals).withColumn("user_key", F.hex("user_key"))
