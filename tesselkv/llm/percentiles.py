"""Exact percentiles per group by a distributed sort.

Partial results are counts per (group, number), which add up over partitions and
days.  The combined counts are sorted over the cluster; counts per (group,
partition) give each partition's offset, the wanted ranks fall into known
partitions, and only these are read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselkv.operators.ordered import run_offsets, sorted_runs

_DIGITS = r"^\s*\+?0*([0-9]+)\s*$"


def partial_counts(df: DataFrame, group: Sequence[str], number: str) -> DataFrame:
    """Columns ``group``, ``number``, n.  Null numbers do not count."""
    return df.where(F.col(number).isNotNull()).groupBy(*group, number).agg(F.count(F.lit(1)).alias("n"))


def combined(parts: Sequence[DataFrame], group: Sequence[str], number: str) -> DataFrame:
    """The partial counts of all ``parts`` together, in the same form."""
    together = reduce(DataFrame.unionByName, parts)
    return together.groupBy(*group, number).agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, group: Sequence[str], number: str, pcts: Sequence[int], as_double: Callable[[Column], Column] = lambda c: c.cast("double")) -> DataFrame:
    """Per group and percentage: ``n``, ``nearest`` and ``between``, both exact.

    ``nearest`` is the smallest number that at least ``pct`` % of the group do not
    exceed.  ``between`` interpolates linearly between the two order statistics
    around place (n-1)*pct/100, as a double; ``low``, ``high`` and ``part`` (hundredths of the
    way between them) are what ``exactly_between`` needs to do so in whole numbers of
    any length.  ``counts`` is what ``partial_counts`` gives.  Ties
    are one row there, so a number that fills a third of a group is no burden.
    A group without numbers has no row; a null group is a group.  ``number`` may be of
    any type that sorts, if ``as_double`` is given.
    """
    runs = sorted_runs(counts, [*group, number])
    parts = run_offsets(runs, group, F.col("n"))
    total = parts.groupBy(*group).agg(F.sum("amount").alias("total"))
    pct = F.explode(F.array(*[F.lit(p) for p in pcts])).alias("pct")
    place = (F.col("total") - 1) * F.col("pct")
    low = F.expr("((total - 1) * pct) div 100")
    ranks = F.map_from_arrays(
        F.array(F.lit("nearest"), F.lit("low"), F.lit("high")),
        F.array(F.expr("greatest((total * pct + 99) div 100, 1)"), low + 1, F.least(low + 2, F.col("total"))),
    )
    wanted = total.select(*group, "total", pct).select(*group, "total", "pct", (place % 100).cast("int").alias("share"), F.explode(ranks).alias("what", "rank"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[g].eqNullSafe(b[g]) for g in group])

    inside = (wanted["rank"] > parts["before"]) & (wanted["rank"] <= parts["before"] + parts["amount"])
    spots = wanted.join(parts, same(wanted, parts) & inside).select(*[wanted[g].alias(f"g{i}") for i, g in enumerate(group)], "total", "pct", "share", "what", (F.col("rank") - F.col("before")).alias("local"), F.col("part").alias("at"))
    needed = spots.select(*[f"g{i}" for i in range(len(group))], "at").distinct()

    def here(rows: DataFrame, other: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [rows[g].eqNullSafe(other[f"g{i}"]) for i, g in enumerate(group)], rows["part"] == other["at"])

    few = runs.join(needed, here(runs, needed), "left_semi")
    upto = Window.partitionBy(*group, "part").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("upto", F.sum("n").over(upto))
    hit = few.join(spots, here(few, spots) & (F.col("local") > F.col("upto") - F.col("n")) & (F.col("local") <= F.col("upto")))
    pick = lambda what: F.max(F.when(F.col("what") == what, F.col(number)))
    found = hit.groupBy(*group, "pct").agg(F.first("total").alias("n"), F.first("share").alias("share"), pick("nearest").alias("nearest"), pick("low").alias("low"), pick("high").alias("high"))
    low, high = as_double(F.col("low")), as_double(F.col("high"))
    between = F.when(low == high, low).otherwise(low + (high - low) * (F.col("share") / 100.0))  # equal ones may be infinite
    return found.select(*group, "pct", "n", "nearest", between.alias("between"), "low", "high", F.col("share").alias("part"))


@F.pandas_udf(T.StringType())
def exactly_between(low: pd.Series, high: pd.Series, part: pd.Series) -> pd.Series:
    """``low`` and ``part`` hundredths of the way to ``high``: whole numbers as text, the result with two decimals.

    For results of ``percentiles``, a few rows a group; null if any is null.
    """

    def one(a: str | None, b: str | None, p: float) -> str | None:
        if a is None or b is None or pd.isna(p):
            return None
        n = int(a) * 100 + (int(b) - int(a)) * int(p)
        return f"{'-' if n < 0 else ''}{abs(n) // 100}.{abs(n) % 100:02}"

    return pd.Series([one(*x) for x in zip(low, high, part, strict=True)], dtype=object)


def whole_number(text: Column) -> Column:
    """A decimal text as a number: blanks around, a plus sign, leading zeros allowed.

    Anything else is null.  Numbers of more than 38 digits count as the greatest
    number of 38 digits, which leaves every smaller percentile as it is; ``wide``
    keeps them.
    """
    digits = F.regexp_extract(text, _DIGITS, 1)
    most = F.lit("9" * 38)
    return F.when(F.length(digits) > 0, F.when(F.length(digits) > 38, most).otherwise(digits)).cast("decimal(38,0)")


def wide(number: Column, text: Column | None = None) -> Column:
    """A whole number of any length that sorts as it does: (number, length, digits).

    ``text`` is what ``number`` was read from by ``whole_number``; length and digits are
    null, and so sort first, unless it has more than 38 of them.
    """
    digits = F.lit(None).cast("string")
    if text is not None:
        digits = F.regexp_extract(text, _DIGITS, 1)
        digits = F.when(F.length(digits) > 38, digits)
    return F.when(number.isNotNull(), F.struct(number.alias("number"), F.length(digits).alias("length"), digits.alias("digits")))


def wide_text(number: Column) -> Column:
    return F.coalesce(number["digits"], number["number"].cast("string"))


def wide_double(number: Column) -> Column:
    return F.coalesce(number["digits"].cast("double"), number["number"].cast("double"))


def big_endian(value: Column) -> Column:
    """The unsigned number in 8 bytes; null for any other length."""
    return F.when(F.octet_length(value) == 8, F.conv(F.hex(value), 16, 10).cast("decimal(38,0)"))
