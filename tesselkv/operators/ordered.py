"""Order statistics, ranks and running sums without one task per group.

``sorted_runs`` sorts a table over the whole cluster and writes it with the number
of the partition each row fell into.  Sums per (group, partition) are small: every
partition boundary splits one group at most, so there are no more than groups plus
partitions of them.  Their running sums give the offset of every partition, and a
window inside one partition does the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselkv.runtime import fresh, written


def sorted_runs(df: DataFrame, by: Sequence[str], part: str = "part") -> DataFrame:
    """``df`` range-partitioned and sorted by ``by``, written, with ``part``."""
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(ranged.withColumn(part, F.spark_partition_id()), "runs")


def run_offsets(runs: DataFrame, group: Sequence[str], amount: Column, part: str = "part") -> DataFrame:
    """Per (group, partition): ``amount`` there and ``before``, its sum in earlier partitions."""
    sums = runs.groupBy(*group, part).agg(F.sum(amount).alias("amount"))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("amount").over(earlier), F.lit(0)))


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], outs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``df`` with running sums and maxima over the group's earlier rows.

    ``outs`` maps a new column to ('sum' or 'max', column).  ``order`` should be unique
    in a group; rows equal in it may lie either way, but each has its own place.
    Null groups form one group.  A null amount counts 0 in a sum, and a sum over
    nothing is 0; a maximum of nothing is null.
    """
    part, at = fresh(df, "part", "at")
    own = dict(zip(outs, fresh(df, *[f"own_{c}" for c in outs]), strict=True))
    how = {"sum": lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))), "max": lambda c: F.max(c)}
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b)}
    runs = sorted_runs(df, [*group, *order], part)
    whole = runs.groupBy(*group, part).agg(*[how[f](c).alias(own[o]) for o, (f, c) in outs.items()])
    parts = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    again = {"sum": F.sum, "max": F.max}
    bases = whole.select(
        *[F.col(g).alias(f"{at}{i}") for i, g in enumerate(group)], F.col(part).alias(f"{at}p"), *[again[f](own[o]).over(parts).alias(f"{at}{o}") for o, (f, _) in outs.items()]
    )
    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = runs.withColumns({own[o]: how[f](c).over(inside) for o, (f, c) in outs.items()})
    same = F.col(part) == F.col(f"{at}p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"{at}{i}"))
    return local.join(bases, same).select(*df.columns, *[join[f](F.col(own[o]), F.col(f"{at}{o}")).alias(o) for o, (f, _) in outs.items()])


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], amount: str, out: str = "before") -> DataFrame:
    """``running`` with one sum."""
    return running(df, group, order, {out: ("sum", amount)})


def salted_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "rank", rows_per_salt: int = 200_000) -> DataFrame:
    """``df`` with ``out``: a place from 0 in its group, without gaps or repeats.

    The order inside a group is by a hash of ``order`` first: any numbering that is
    fixed by the data will do where the members of a group are interchangeable.
    Null groups form one group; repeated rows have a place each.
    """
    salt, base, at = fresh(df, "salt", "base", "at")
    salts = max(1, -(-df.count() // rows_per_salt))
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    earlier = Window.partitionBy(*group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(*group, salt).agg(F.count(F.lit(1)).alias(base))
    bases = counts.withColumn(base, F.coalesce(F.sum(base).over(earlier), F.lit(0)))
    placed = salted.withColumn(out, F.row_number().over(Window.partitionBy(*group, salt).orderBy(*order)) - 1)
    bases = bases.select(*[F.col(g).alias(f"{at}{i}") for i, g in enumerate(group)], F.col(salt).alias(f"{at}s"), base)
    same = F.col(salt) == F.col(f"{at}s")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"{at}{i}"))
    joined = placed.join(bases, same)
    return joined.select(*df.columns, (F.col(out) + F.col(base)).alias(out))
