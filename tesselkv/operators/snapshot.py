"""Reads at a version: latest, as of, points, ranges, neighbours, history.

Visibility has a fixed order: blanks are dropped, versions above ``read_ts`` are
dropped, the greatest version of each key is taken, and only then deleted and
expired records are masked: a newer tombstone hides older live versions.

The rank keeps one row per key and partition before it shuffles, so a key with a
third of all rows is no burden.  Records with a null key or version are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselkv import schema as S
from tesselkv.operators.ordered import sorted_runs
from tesselkv.operators.skew import sliced, unique_join
from tesselkv.runtime import fresh, set_aside, settled, written


def last_written(records: DataFrame, arrival: str) -> DataFrame:
    """One row per (key, version): of rows written again, the last by ``arrival``."""
    (rank,) = fresh(records, "rank")
    w = Window.partitionBy("user_key", "version").orderBy(F.col(arrival).desc())
    real = records.where(F.col("user_key").isNotNull() & F.col("version").isNotNull())
    return real.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def newest(kv: DataFrame, read_ts: int | None = None, arrival: str | None = None) -> DataFrame:
    """The chosen record of every key: greatest version up to ``read_ts``, unmasked.

    Of repeated rows of one version one is taken; they should be equal.  With
    ``arrival`` the last that arrived is taken in the same rank, which saves the
    shuffle of ``last_written``; a blank row then leaves the row it repeats standing.
    """
    (rank,) = fresh(kv, "rank")
    real = kv.where(F.col("user_key").isNotNull() & F.col("version").isNotNull() & ~F.coalesce(S.blank(), F.lit(False)))
    upto = real if read_ts is None else real.where(F.col("version") <= read_ts)
    w = Window.partitionBy("user_key").orderBy(F.col("version").desc(), *([F.col(arrival).desc()] if arrival else []))
    return upto.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def snapshot(kv: DataFrame, now: int, read_ts: int | None = None, arrival: str | None = None) -> DataFrame:
    """The visible record of every key at ``read_ts`` and the second ``now``."""
    return newest(kv, read_ts, arrival).where(~S.gone(now))


def masked(kv: DataFrame, now: int, read_ts: int | None = None, arrival: str | None = None) -> DataFrame:
    """Keys whose chosen record is hidden, with ``why``: deleted or expired."""
    why = F.when(S.deleted(), "deleted").otherwise("expired")
    return newest(kv, read_ts, arrival).where(S.gone(now)).withColumn("why", why)


def point_get(kv: DataFrame, key: bytes, now: int, read_ts: int | None = None, arrival: str | None = None) -> DataFrame:
    """``snapshot`` of one key; the key reaches the scan as a predicate."""
    return snapshot(kv.where(F.col("user_key") == S.key_bytes(key)), now, read_ts, arrival)


def history(kv: DataFrame, key: bytes) -> DataFrame:
    """All versions of one key, newest first."""
    return kv.where(F.col("user_key") == S.key_bytes(key)).orderBy(F.col("version").desc())


def scan(kv: DataFrame, now: int, read_ts: int | None = None, within: Column | None = None, reverse: bool = False, limit: int | None = None, arrival: str | None = None) -> DataFrame:
    """Visible records in key order, backwards if ``reverse``."""
    some = snapshot(kv if within is None else kv.where(within), now, read_ts, arrival)
    ordered = some.orderBy(F.col("user_key").desc() if reverse else F.col("user_key").asc())
    return ordered if limit is None else ordered.limit(limit)


def seek(kv: DataFrame, key: bytes, limit: int = 1) -> DataFrame:
    """The first ``limit`` records at or after ``key``: by key, newest version first."""
    return kv.where(S.in_range(key)).orderBy("user_key", F.col("version").desc()).limit(limit)


def neighbours(keys: DataFrame) -> DataFrame:
    """Distinct keys of ``keys`` with ``before`` and ``after``, null at the ends.

    The keys are sorted over the cluster; inside a partition neighbours are next to
    each other, and only the ends of partitions look further, one row each.
    """
    runs = sorted_runs(keys.select("user_key").where("user_key IS NOT NULL").distinct(), ["user_key"])
    inside = Window.partitionBy("part").orderBy("user_key")
    ends = runs.groupBy("part").agg(F.min("user_key").alias("lo"), F.max("user_key").alias("hi"))
    outer = Window.orderBy("lo")  # one row a partition
    ends = ends.select("part", F.lag("hi").over(outer).alias("prev"), F.lead("lo").over(outer).alias("next"))
    near = runs.withColumn("before", F.lag("user_key").over(inside)).withColumn("after", F.lead("user_key").over(inside))
    return near.join(ends, "part").select("user_key", F.coalesce("before", "prev").alias("before"), F.coalesce("after", "next").alias("after"))


#: Asked keys whose hashes may be broadcast to filter the records: 8 MB of them.
BROADCAST_KEYS = 1_000_000


def with_keys(kv: DataFrame, keys: DataFrame, key: str = "user_key") -> DataFrame:
    """Rows of ``kv`` whose ``key`` is one of ``keys`` (one column of that name, distinct).

    Up to ``BROADCAST_KEYS`` keys their hashes are broadcast, and the rows are thinned
    where they are read; of hash collisions a few more rows may stay, so compare keys
    afterwards.  More keys meet the rows in a join by key, heavy keys spread.
    """
    n = keys.count()
    if n > BROADCAST_KEYS:
        return unique_join(kv, keys, key, "version")
    (h,) = fresh(kv, "h")
    hashes = keys.select(F.xxhash64(key).alias(h)).distinct()
    return kv.join(F.broadcast(hashes), F.xxhash64(kv[key]) == F.col(h), "left_semi")


def beside(kv: DataFrame, key: bytes) -> DataFrame:
    """One row: the greatest key ``before`` and the least ``after`` ``key``, and the ``last`` of all; null where none is.

    Keys of any version count, hidden ones too.  Minima and maxima combine before the
    shuffle, so nothing is sorted.
    """
    at, k = F.col("user_key"), S.key_bytes(key)
    before, after = F.max(F.when(at < k, at)), F.min(F.when(at > k, at))
    return kv.agg(before.alias("before"), after.alias("after"), F.max(at).alias("last"))


def multi_get(
    lookups: DataFrame, kv: DataFrame, now: int, heavy_rows: int | None = None, arrival: str | None = None
) -> DataFrame:
    """As-of reads of many keys: per lookup (lookup_id, user_key, read_ts) its visible record.

    A lookup without a visible record has no row.  Only records of asked keys are
    looked at (``with_keys``).  Their versions and the lookups are ordered together,
    each lookup taking the last version up to it, so none is paired with all versions
    of its key.  A heavy key is sliced by version, the last version of earlier slices
    being carried into each; many lookups of one key at one ``read_ts`` (the greatest,
    for the latest) are a slice of several parts, which carries its own version too.
    Of repeated rows of a version the last by ``arrival`` is taken, without it the
    greatest by its columns.  Runs jobs.
    """
    kv, undo = set_aside(kv, [*S.KV_COLUMNS, *([arrival] if arrival else [])])
    real = kv.where(F.col("user_key").isNotNull() & F.col("version").isNotNull())
    asked = lookups.select(F.col("lookup_id").cast("bigint").alias("lookup_id"), "user_key", F.col("read_ts").cast("bigint").alias("at"))
    asked = settled(asked.where("user_key IS NOT NULL AND at IS NOT NULL"), "asked")
    rows = with_keys(real, asked.select("user_key").distinct())
    if arrival is None:
        rows = rows.where(~F.coalesce(S.blank(), F.lit(False)))
        slim = rows.select("user_key", "version")
    else:  # a version written again by a blank is none
        last = F.max_by(F.coalesce(S.blank(), F.lit(False)), arrival).alias("blank")
        slim = rows.groupBy("user_key", "version").agg(last).where("NOT blank").select("user_key", "version")
    nothing, kind = F.lit(None).cast("bigint"), F.lit(0).alias("kind")
    both = slim.select("user_key", F.col("version").alias("at"), F.col("version").alias("v"), nothing.alias("lookup_id"), kind)
    both = both.unionByName(asked.select("user_key", "at", nothing.alias("v"), "lookup_id", F.lit(1).alias("kind")))
    both, any_heavy = sliced(settled(both, "asof"), "user_key", "at", "slice", "part", ["lookup_id"], heavy_rows)
    w = Window.partitionBy("user_key", "slice", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("version", F.max("v").over(w))
    if any_heavy:
        tops = both.where("slice > 0").groupBy("user_key", "slice").agg(F.max("v").alias("v"), F.max("part").alias("parts"))
        earlier = Window.partitionBy("user_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = F.greatest(F.max("v").over(earlier), F.when(F.col("parts") > 0, F.col("v")))
        into = tops.select("user_key", "slice", carried.alias("carried")).where("carried IS NOT NULL")
        hit = hit.join(F.broadcast(into), ["user_key", "slice"], "left").withColumn("version", F.greatest("version", "carried"))
    found = F.struct("user_key", "version").alias("kv_id")
    hit = written(hit.where("kind = 1 AND version IS NOT NULL").select("lookup_id", found), "hits")
    wanted = hit.select("kv_id.user_key", "kv_id.version").distinct()
    records = last_any(rows.join(wanted, ["user_key", "version"], "left_semi"), arrival).where(~S.gone(now))
    whole = unique_join(hit, records.withColumn("kv_id", F.struct("user_key", "version")), "kv_id", "lookup_id")
    return undo(whole.drop("kv_id", *([arrival] if arrival and arrival not in S.KV_COLUMNS else [])))


def last_any(kv: DataFrame, arrival: str | None = None) -> DataFrame:
    """One row of each (key, version): the last by ``arrival``, else the greatest by its columns."""
    (rank,) = fresh(kv, "rank")
    if arrival:
        order = [F.col(arrival).desc()]
    else:
        order = [F.col(c).desc() for c in ("meta", "expires_at", "user_meta", "value", "vptr")]
    w = Window.partitionBy("user_key", "version").orderBy(*order)
    return kv.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)
