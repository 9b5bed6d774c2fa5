"""Per-key work on tables where a few keys hold most rows.

A key is heavy when it has more rows than half a fair task's share, the share
being all rows over ``spark.sql.shuffle.partitions``.  So there are at most twice as
many heavy keys as partitions, and no other key can make a task large, at any size.
Rows are counted per key before the shuffle, together with a sample of each key's
places in the order, in one pass.  Keys travel as 64-bit hashes; two keys that
share a hash only share the salting, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselkv.runtime import fresh

#: A key of fewer rows is no burden to a task, however few rows there are in all.
LEAST_ROWS = 1000
#: One row in so many tells how a heavy key's rows lie in their order.
SAMPLE = 16
#: Samples per slice that come to the driver, about.
SAMPLES_A_SLICE = 64
_SEED = 7


class Merged(NamedTuple):
    """An aggregate that can be merged: ``partial`` of rows, ``merge`` of partials."""

    name: str
    partial: Column
    merge: Callable[[str], Column]


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _counts(df: DataFrame, keys: Sequence[str], at: Column, heavy_rows: int | None) -> tuple[DataFrame, int, dict[int, int]]:
    """(counts, rows that make a key heavy, rows of each heavy hash), from one pass over ``df``.

    ``counts`` (h, at, n) has every sampled row by its place ``at``, and with a null
    place the other rows of each hash, unless they are too few to matter.  It is kept
    for the caller to unpersist.
    """
    least = min(LEAST_ROWS, heavy_rows or LEAST_ROWS)
    place = F.when(F.rand(_SEED) * SAMPLE < 1, at)
    counts = df.select(key_hash(keys).alias("h"), place.alias("at")).groupBy("h", "at").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where((F.col("n") > least // 2) | F.col("at").isNotNull()).persist()
    by_key = counts.groupBy("h").agg(F.sum("n").alias("n"))
    if heavy_rows is None:
        most = 2 * partitions(df.sparkSession)
        total = counts.where("at IS NOT NULL").agg(F.lit(None).cast("bigint").alias("h"), F.sum("n").alias("n"))
        found = by_key.orderBy(F.col("n").desc(), "h").limit(most).unionByName(total).collect()
        all_rows = SAMPLE * (next(r.n for r in reversed(found) if r.h is None) or 0)
        heavy_rows = max(LEAST_ROWS, all_rows // most)
    else:
        found = by_key.where(F.col("n") > heavy_rows).collect()
    return counts, heavy_rows, {r.h: r.n for r in found if r.h is not None and r.n > heavy_rows}


def heavy_hashes(df: DataFrame, keys: Sequence[str], heavy_rows: int | None = None) -> list[int]:
    """Hashes of the heavy keys: at most twice as many as there are partitions.

    Where ``heavy_rows`` is given, keys of more rows than that are heavy instead.
    Runs a job.
    """
    counts, _, heavy = _counts(df, keys, F.lit(0), heavy_rows)
    counts.unpersist()
    return sorted(heavy)


def is_heavy(keys: Sequence[str], heavy: list[int]) -> Column:
    return key_hash(keys).isin(heavy) if heavy else F.lit(False)


def _cuts(places: pd.DataFrame, rows: int, each: int) -> tuple[list[int], list[int]]:
    """(cuts, parts): where a heavy key's order is cut, and into how many parts each slice is.

    ``places`` (at, n) are weighted samples in order.  A slice begins at its cut and
    holds about ``each`` rows; a place that alone holds more is a slice of its own,
    of several parts.
    """
    at, n = places["at"].to_numpy(np.int64), places["n"].to_numpy(float)
    n = n * (rows / n.sum())
    cuts, parts, held = [], [], 0.0
    for i, (x, w) in enumerate(zip(at.tolist(), n.tolist(), strict=True)):
        if w > each:
            cuts.append(x)
            parts.append(int(-(-w // each)))
            if x < (1 << 63) - 1:
                cuts.append(x + 1)
                parts.append(1)
            held = 0.0
            continue
        if held and held + w > each and i:
            cuts.append(x)
            parts.append(1)
            held = 0.0
        held += w
    whole: dict[int, int] = {}
    for c, p in zip(cuts, parts, strict=True):
        whole[c] = max(p, whole.get(c, 1))
    return list(whole), [1, *whole.values()]


def _last_at_most(cuts: Column, value: Column, most: int) -> Column:
    """How many of the sorted ``cuts`` (``most`` at most) are <= ``value``, by halving."""
    steps = [1 << i for i in reversed(range(max(1, most.bit_length())))]
    found = lambda n, step: F.when(F.get(cuts, n + step - 1) <= value, n + step).otherwise(n)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), found)


def sliced(rows: DataFrame, key: str, order: str, slice_: str, part: str, spread: Sequence[str] = (), heavy_rows: int | None = None) -> tuple[DataFrame, bool]:
    """``rows`` with ``slice_`` and ``part``, both 0 for a light key, and whether there is a heavy one.

    A heavy key's rows are cut along ``order`` (whole numbers, no nulls) at the key's
    own quantiles, into slices 1, 2, ... of about a fair share each.  Rows that tie
    in ``order`` lie in one slice; a place that alone holds more than a share is a
    slice of itself, cut into parts by a hash of ``spread`` (one part without it).
    The cuts rest on a sample and decide only who does the work.  They come to the
    driver and are broadcast: a number per slice, so three per partition at most.
    Runs jobs: one pass over ``rows``, of the columns ``key`` and ``order``.
    """
    spark = rows.sparkSession
    counts, each, heavy = _counts(rows, [key], F.col(order).cast("bigint"), heavy_rows)
    if not heavy:
        counts.unpersist()
        return rows.withColumns({slice_: F.lit(0), part: F.lit(0)}), False
    # Thinned so that a sample stands for ``thin`` rows at least; a place keeps its weight.
    thin = max(1, sum(heavy.values()) // SAMPLE // (SAMPLES_A_SLICE * 3 * partitions(spark)))
    some = counts.where(F.col("at").isNotNull() & F.col("h").isin(list(heavy)) & (F.pmod(F.xxhash64("h", "at"), F.lit(thin)) < F.col("n")))
    places = some.select("h", "at", F.greatest("n", F.lit(thin)).alias("n")).toPandas()
    counts.unpersist()
    found = [(h, *_cuts(own.sort_values("at"), heavy[h], each)) for h, own in places.groupby("h")]
    known = spark.createDataFrame(found, "_h bigint, _cuts array<bigint>, _parts array<int>")
    most = max((len(c) for _, c, _ in found), default=0)
    h, cuts, parts = fresh(rows, "h", "cuts", "parts")
    known = known.toDF(h, cuts, parts)
    both = rows.join(F.broadcast(known), key_hash([key]) == F.col(h), "left")
    at = F.when(F.col(cuts).isNull(), 0).otherwise(1 + _last_at_most(F.col(cuts), F.col(order), most))
    both = both.withColumn(slice_, at)
    of = F.get(F.col(parts), F.col(slice_) - 1)
    spreads = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), of).cast("int") if spread else F.lit(0)
    return both.withColumn(part, F.when(of > 1, spreads).otherwise(0)).drop(h, cuts, parts), True


def salted_aggregate(df: DataFrame, keys: Sequence[str], merged: Sequence[Merged], spread_by: Sequence[str], heavy_rows: int | None = None, salts: int = 64) -> DataFrame:
    """Two-stage aggregation: partials per (key, salt), then merged per key.

    The salt of a heavy key's row is a hash of ``spread_by``, not a random number,
    so a recomputed task draws the same salts.  Light keys have the salt 0.
    Null keys form one group, as in SQL.  An empty table gives no rows.
    """
    (salt,) = fresh(df, "salt")
    heavy = heavy_hashes(df, keys, heavy_rows)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    salted = df.withColumn(salt, F.when(is_heavy(keys, heavy), spread).otherwise(F.lit(0)))
    partial = salted.groupBy(*keys, salt).agg(*[m.partial.alias(m.name) for m in merged])
    return partial.groupBy(*keys).agg(*[m.merge(m.name).alias(m.name) for m in merged])


def late_rows(df: DataFrame, key: str, order: str, version: str, heavy_rows: int | None = None) -> DataFrame:
    """Rows of ``df`` behind a greater ``version`` of their key in order of ``order``.

    A row is late when another row with the same key has a smaller ``order`` and a
    greater ``version``.  The result depends on order, so the salt of a heavy key
    is the slice of ``order`` the row lies in (``sliced``).  Stage one takes the maximum
    of each (key, slice); merging these by key gives the maximum carried into each
    slice, a row per slice, which is broadcast.  Stage two runs over each (key, slice)
    by itself.  Both stages read one shuffle of the rows.

    Rows with a null key, order or version are never late and hide nothing.  Equal
    ``order`` values do not precede each other.  Repeated rows are judged each for
    itself.  All columns of ``df`` are kept.
    """
    slice_, part, carried, best, top = fresh(df, "slice", "part", "carried", "best", "top")
    rows = df.where(F.col(key).isNotNull() & F.col(order).isNotNull() & F.col(version).isNotNull())
    spread = [c for c in (version, *df.columns) if c not in (key, order)]
    rows, any_heavy = sliced(rows, key, order, slice_, part, list(dict.fromkeys(spread)), heavy_rows)
    by = [key, slice_, part]
    # Rows that tie in ``order`` come by version, so those before a row are not greater and hide nothing.
    earlier = Window.partitionBy(*by).orderBy(order, version).rowsBetween(Window.unboundedPreceding, -1)
    if any_heavy:
        rows = rows.repartition(*by)
    judged = rows.withColumn(best, F.max(version).over(earlier))
    if any_heavy:
        # ``top`` and the least order keep this branch on the rows and columns of the other: one shuffle serves both.
        tops = rows.groupBy(*by).agg(F.max(version).alias(best), F.max(slice_).alias(top), F.min(order).alias(carried))
        tops = tops.where((F.col(top) > 0) & F.col(carried).isNotNull())
        before = Window.partitionBy(key).orderBy(slice_).rangeBetween(Window.unboundedPreceding, -1)
        into = tops.select(*by, F.max(best).over(before).alias(carried)).where(F.col(carried).isNotNull())
        judged = judged.join(F.broadcast(into), by, "left").withColumn(best, F.greatest(best, carried))
    return judged.where(F.col(best) > F.col(version)).select(*df.columns)


def unique_join(rows: DataFrame, facts: DataFrame, key: str, spread_by: str, how: str = "inner", heavy_rows: int | None = None, salts: int = 64) -> DataFrame:
    """Join ``rows`` to ``facts``, which has one row per key, without a hot task.

    Facts of heavy keys are repeated once per salt (at most ``salts`` rows more for
    each heavy key); the rows of a heavy key are spread over the salts by
    ``spread_by``.  Null keys match nothing.
    """
    heavy = heavy_hashes(rows, [key], heavy_rows)
    if not heavy:
        return rows.join(facts, key, how)
    (salt,) = fresh(rows.join(facts, key), "salt")
    left = rows.withColumn(salt, F.when(is_heavy([key], heavy), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    every = F.when(is_heavy([key], heavy), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = facts.withColumn(salt, F.explode(every))
    return left.join(right, [key, salt], how).drop(salt)
