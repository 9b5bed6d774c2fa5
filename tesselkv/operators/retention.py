"""Which versions compaction keeps, and what it frees.

Per key, versions newest first: a version at or below ``discard_ts`` that is no
merge entry counts.  The first counted version that is deleted, expired, marked to
discard earlier ones, or the last of ``keep`` versions stops the key: everything
older goes.  The stopping version itself goes if it is deleted or expired and no
deeper level may hold the key.  Keys under a dropped prefix go first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselkv import schema as S
from tesselkv.operators.skew import sliced, unique_join
from tesselkv.runtime import set_aside, settled


def judged(
    kv: DataFrame,
    now: int,
    discard_ts: int,
    keep: int = 1,
    has_overlap: bool = False,
    drop_prefixes: Sequence[bytes] = (),
    heavy_rows: int | None = None,
) -> DataFrame:
    """``kv`` with ``dropped`` and ``stale`` (kept, but only for what lies below it).

    One row per (key, version) is expected.  A heavy key is cut into slices by
    version; what older slices need of newer ones (how many versions counted, whether
    the key was stopped, whether its newest version discards) is summed per slice and
    carried by a broadcast of a row per slice, so no task sees a whole heavy key.
    Records with a null key or version are left out.  Runs jobs; what is more than a
    scan is written once, as it is read three times (twice of narrow columns).
    """
    kv = settled(kv.where(F.col("user_key").isNotNull() & F.col("version").isNotNull()), "kv")
    kv, undo = set_aside(kv, S.KV_COLUMNS)
    under = reduce(lambda a, b: a | b, [S.in_prefix(p) for p in drop_prefixes], F.lit(False))
    counts = (F.col("version") <= discard_ts) & ~S.has(S.MERGE)
    rows = kv.withColumn("elig", counts.cast("int")).withColumn("gone", S.gone(now))
    rows = rows.withColumn("mark", S.has(S.DISCARD_EARLIER)).withColumn("under", under)
    alive, any_heavy = sliced(rows.where(~F.col("under")), "user_key", "version", "slice", "part", heavy_rows=heavy_rows)
    newer = Window.partitionBy("user_key", "slice").orderBy(F.col("version").desc())
    if any_heavy:
        hard = (F.col("elig") == 1) & (F.col("gone") | F.col("mark"))
        sums = alive.where("slice > 0").groupBy("user_key", "slice").agg(
            F.sum("elig").alias("n"), F.max(hard).alias("hard"), F.max_by("mark", "version").alias("top")
        )
        before = Window.partitionBy("user_key").orderBy(F.col("slice").desc())  # newer slices first
        earlier = before.rowsBetween(Window.unboundedPreceding, -1)
        n, hard, top = F.sum("n").over(earlier), F.max("hard").over(earlier), F.first("top").over(before)
        carried = sums.select("user_key", "slice", n.alias("n0"), hard.alias("hard0"), top.alias("top0"))
        alive = alive.join(F.broadcast(carried), ["user_key", "slice"], "left")
        n0, hard0, top0 = F.coalesce("n0", F.lit(0)), F.coalesce("hard0", F.lit(False)), F.col("top0")
    else:
        n0, hard0, top0 = F.lit(0), F.lit(False), F.lit(None).cast("boolean")
    n = n0 + F.sum("elig").over(newer.rowsBetween(Window.unboundedPreceding, 0))
    with_n = alive.withColumn("n", n).withColumn("top", F.coalesce(top0, F.first("mark").over(newer)))
    with_n = with_n.withColumn("was", hard0 | (n0 >= keep))
    stop = (F.col("elig") == 1) & (F.col("gone") | F.col("mark") | (F.col("n") == keep))
    stopped = with_n.withColumn("stop", stop)
    last = F.max("stop").over(newer.rowsBetween(Window.unboundedPreceding, -1))
    after = F.coalesce(last, F.lit(False)) | F.col("was")
    dropped = after | (F.col("stop") & F.col("gone") & F.lit(not has_overlap))
    told = stopped.withColumn("dropped", dropped).withColumn("stale", ~F.col("dropped") & (F.col("top") | F.col("gone")))
    whole = told.select(*kv.columns, "dropped", "stale")
    if drop_prefixes:
        below = rows.where("under").select(*kv.columns, F.lit(True).alias("dropped"), F.lit(False).alias("stale"))
        whole = whole.unionByName(below)
    return undo(whole)


def kept(judged_kv: DataFrame) -> DataFrame:
    return judged_kv.where(~F.col("dropped")).drop("dropped", "stale")


def discard_stats(judged_kv: DataFrame, length: str = "len") -> DataFrame:
    """Bytes of the value log that dropped records no longer point to, by file."""
    freed = judged_kv.where(F.col("dropped") & S.has(S.VALUE_POINTER) & F.col("vptr").isNotNull())
    return freed.groupBy(F.col("vptr.fid").cast("bigint").alias("fid")).agg(F.sum(F.col(f"vptr.{length}").cast("bigint")).alias("bytes"))


def accumulate_discards(stats: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """``stats`` (fid, bytes) after ``changes`` (fid, n): add n, or back to 0 if n < 0.

    With ``order``, a column of ``changes``, what follows the last reset of a file still
    counts; without it a reset in a batch holds for the whole batch.
    """
    resets = changes.where("n < 0").groupBy("fid").agg(F.max(order if order else "n").alias("_last"))
    if order is None:
        after = changes.join(resets, "fid", "left_anti")
    else:
        after = unique_join(changes, resets, "fid", order, "left").where(F.col("_last").isNull() | (F.col(order) > F.col("_last")))
    base = stats.select("fid", F.col("bytes").alias("n")).join(resets, "fid", "left_anti")
    both = base.unionByName(after.select("fid", "n")).unionByName(resets.select("fid", F.lit(0).alias("n")))
    return both.where("fid IS NOT NULL").groupBy("fid").agg(F.sum("n").cast("bigint").alias("bytes"))


def stale_size(judged_kv: DataFrame) -> DataFrame:
    """One row: number and bytes (key, value, 12 of headers) of records kept but stale."""
    bytes_ = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 12
    stale = judged_kv.where("stale")
    return stale.agg(F.count(F.lit(1)).alias("n_stale"), F.coalesce(F.sum(bytes_.cast("bigint")), F.lit(0)).alias("stale_bytes"))
