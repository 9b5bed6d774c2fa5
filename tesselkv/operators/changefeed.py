"""Current state of a table from a feed of creates, moves and deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselkv.runtime import fresh

UPSERT, DELETE = "CREATE", "DELETE"


def plain_op(op: Column) -> Column:
    """CREATE or DELETE of its spellings: any case, blanks, or the enum's 0 and 1.

    Anything else, null included, is null.
    """
    bare = F.upper(F.trim(op.cast("string")))
    return F.when(bare.isin(UPSERT, "0"), UPSERT).when(bare.isin(DELETE, "1"), DELETE)


def latest_changes(changes: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """The last change of every key, by ``seq``, with ``op`` in its plain spelling.

    Copies of one change (equal ``key`` and ``seq``) count once; where they differ the
    greatest of each column holds (CREATE before DELETE), so a task that runs again
    finds the same.  Changes without a key, a sequence number or a readable operation
    say nothing and are left out.  The ranking keeps one row per key and partition
    before it shuffles, so a key with a third of all changes makes no large task.
    Columns must be of types that sort.
    """
    rank, made = fresh(changes, "rank", "made")
    # A flag in place of the spelling: with fixed-width columns copies are dropped by hash.
    read = changes.withColumn(made, plain_op(F.col(op)) == UPSERT).drop(op)
    read = read.where(F.col(key).isNotNull() & F.col(seq).isNotNull() & F.col(made).isNotNull())
    once = read.groupBy(key, seq).agg(*[F.max(c).alias(c) for c in read.columns if c not in (key, seq)])
    last = Window.partitionBy(key).orderBy(F.col(seq).desc())
    first = once.withColumn(rank, F.row_number().over(last)).where(F.col(rank) == 1)
    return first.withColumn(op, F.when(F.col(made), UPSERT).otherwise(DELETE)).select(*changes.columns)


def merged_changes(base: DataFrame | None, changes: DataFrame, key: str, seq: str, op: str, keep: Sequence[str]) -> DataFrame:
    """The state ``base`` after ``changes``: columns ``key``, ``seq``, ``op`` and ``keep``, deletes included.

    A deleted key stays with the ``seq`` of its delete, so an older change that comes
    late finds it and does nothing: parts of a feed may be merged in any order and any
    number of times.  ``base`` is None for an empty one, a state made here, or a plain
    table without ``op``, whose rows exist.
    """
    names = [key, seq, op, *[c for c in keep if c not in (key, seq, op)]]
    last = latest_changes(changes.select(*names), key, seq, op)
    if base is None:
        return last
    old = base if op in base.columns else base.withColumn(op, F.lit(UPSERT))
    return latest_changes(old.select(*names).unionByName(last), key, seq, op)


def existing(state: DataFrame, op: str) -> DataFrame:
    """Rows of a state that exist, without ``op``."""
    return state.where(F.col(op) == UPSERT).drop(op)


def apply_changes(base: DataFrame | None, changes: DataFrame, key: str, seq: str, op: str, keep: Sequence[str]) -> DataFrame:
    """``base`` after all ``changes``, what exists only: columns ``key``, ``seq`` and ``keep``.

    A change no newer than what ``base`` holds of its key does nothing.  For feeds
    whose parts come late keep the state of ``merged_changes`` as the next base: it
    remembers deletes, which this result does not.
    """
    state = merged_changes(base, changes, key, seq, op, keep)
    return existing(state, op).select(key, seq, *[c for c in keep if c not in (key, seq)])
