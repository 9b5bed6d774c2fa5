"""Merging sorted runs, overlays and set differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselkv import schema as S
from tesselkv.operators.skew import unique_join
from tesselkv.runtime import fresh


def merge_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """One row per (user_key, version) of all ``sources``; an earlier source wins.

    Give runs newest first: pending, delta, flushed runs newest first, then the lower
    levels.  A source with two rows of one version keeps one of them.  Nested merges
    and single runs mix freely, as all are DataFrames.
    """
    if not sources:
        raise ValueError("nothing to merge")
    (rank,) = fresh(sources[0], "rank")
    together = reduce(DataFrame.unionByName, [s.withColumn(rank, F.lit(i)) for i, s in enumerate(sources)])
    first = Window.partitionBy("user_key", "version").orderBy(rank)
    return together.withColumn(rank + "n", F.row_number().over(first)).where(F.col(rank + "n") == 1).drop(rank, rank + "n")


def overlay(pending: DataFrame, base: DataFrame) -> DataFrame:
    """``base`` (one row per key) with the rows of ``pending`` instead of its own.

    Every pending row counts, tombstones too: mask afterwards.
    """
    (rank,) = fresh(base, "rank")
    both = pending.withColumn(rank, F.lit(0)).unionByName(base.withColumn(rank, F.lit(1)))
    first = Window.partitionBy("user_key").orderBy(rank, F.col("version").desc())
    return both.withColumn(rank + "n", F.row_number().over(first)).where(F.col(rank + "n") == 1).drop(rank, rank + "n")


def differences(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: columns ``key`` and ``side``, 'extra' or 'missing'."""
    a, b = have.select(key).distinct(), want.select(key).distinct()
    extra = a.join(b, key, "left_anti").withColumn("side", F.lit("extra"))
    return extra.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("missing")))


def merge_entries(kv: DataFrame, now: int, aggregates: Sequence[Column], read_ts: int | None = None) -> DataFrame:
    """Per key ``aggregates`` over its newest plain record and the merge entries above it.

    A plain record that is deleted or expired is an empty start; a key of merge
    entries alone has none.  The aggregates combine before the shuffle, and rows of a
    heavy key meet their key's start spread over several tasks.  One row per
    (key, version) is expected; blanks don't count.
    """
    rows = kv.where(F.col("user_key").isNotNull() & F.col("version").isNotNull() & ~F.coalesce(S.blank(), F.lit(False)))
    rows = rows if read_ts is None else rows.where(F.col("version") <= read_ts)
    starts = rows.groupBy("user_key").agg(F.max(F.when(~S.has(S.MERGE), F.col("version"))).alias("_start"))
    both = unique_join(rows, starts, "user_key", "version")
    counts = F.col("_start").isNull() | (F.col("version") > F.col("_start")) | ((F.col("version") == F.col("_start")) & ~S.gone(now))
    return both.where(counts).groupBy("user_key").agg(*aggregates)
