"""Conflicts, watermarks and recovery of transactions, in bulk."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tesselkv.operators.ordered import running, running_sum
from tesselkv.operators.skew import sliced
from tesselkv.runtime import release, settled, written


def conflict_candidates(reads: DataFrame, writes: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """Transactions that read a key another one committed meanwhile, if all others commit.

    ``reads`` (txn_id, key, read_ts, commit_ts), ``writes`` (commit_ts, key).  One row
    per transaction: ``n_keys`` read keys in conflict and ``first_ts``, the first such
    commit.  A read looks for the first write of its key after ``read_ts``; if that
    is not before its own commit, none is, so each read meets one write instead of
    all writes of its key.  A heavy key is sliced by time, the first write of later
    slices being carried into each.  Null keys conflict with nothing.  Runs jobs.
    """
    nothing = F.lit(None).cast("bigint")
    w = writes.where("key IS NOT NULL").select("key", F.col("commit_ts").cast("bigint").alias("at")).distinct()
    w = w.select("key", "at", F.col("at").alias("w"), F.lit(1).alias("kind"), nothing.alias("txn_id"), nothing.alias("commit_ts"))
    r = reads.where("key IS NOT NULL AND read_ts IS NOT NULL")
    r = r.select("key", F.col("read_ts").cast("bigint").alias("at"), nothing.alias("w"), F.lit(2).alias("kind"), "txn_id", "commit_ts")
    both, any_heavy = sliced(settled(w.unionByName(r), "marks"), "key", "at", "slice", "part", ["txn_id"], heavy_rows)
    later = Window.partitionBy("key", "slice", "part").orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # At equal times the read comes first in this order, so only later writes lie before it.
    met = both.withColumn("first_ts", F.min("w").over(later))
    if any_heavy:  # a slice of one time in several parts has no write later than its reads
        firsts = both.where("slice > 0").groupBy("key", "slice").agg(F.min("w").alias("w"))
        after = Window.partitionBy("key").orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
        into = firsts.select("key", "slice", F.min("w").over(after).alias("carried")).where("carried IS NOT NULL")
        met = met.join(F.broadcast(into), ["key", "slice"], "left").withColumn("first_ts", F.least("first_ts", "carried"))
    met = met.where("kind = 2 AND first_ts < commit_ts")
    return met.groupBy("txn_id").agg(F.countDistinct("key").alias("n_keys"), F.min("first_ts").alias("first_ts"))


def resolve(txns: Iterable[tuple[int, int, set, set]]) -> dict[int, bool]:
    """Exact outcome of (txn_id, read_ts, reads, writes) in order of commit: id -> committed.

    Sequential by nature: a transaction that is refused publishes no writes.
    """
    last: dict = {}
    out = {}
    for ts, (txn, read_ts, reads, writes) in enumerate(txns):
        out[txn] = all(last.get(k, -1) <= read_ts for k in reads)
        if out[txn]:
            last.update(dict.fromkeys(writes, ts))
    return out


def conflicts_resolved(reads: DataFrame, writes: DataFrame, rounds: int = 8) -> DataFrame:
    """Refused transactions exactly: columns txn_id, commit_ts.

    Resolved in rounds.  Along the sorted times of each key a read looks for the last
    write before its own commit, once among writes that are sure (their transaction
    has committed) and once among all that are not refused: one of the first after
    ``read_ts`` refuses the transaction, none of the second lets it commit.  So a read
    meets two running maxima, not all writes of its key, and a hot key is cut where
    the sort cuts it.  The earliest open transaction always settles.  Chains take as
    many rounds as they are long: what ``rounds`` leave open is settled in one pass in
    order of commit, as each outcome needs the one before.  Null keys conflict with
    nothing.  Runs jobs.
    """
    r = reads.where("key IS NOT NULL AND read_ts IS NOT NULL AND commit_ts - 1 > read_ts")
    r = written(r.select("txn_id", "key", "read_ts", F.col("commit_ts").alias("mine")), "reads")
    asked = r.select("key").distinct()
    w = writes.where("key IS NOT NULL").select("key", F.col("commit_ts").alias("at")).distinct()
    w = written(w.join(asked, "key", "left_semi").withColumn("sure", F.lit(False)), "writes")
    refused: list[DataFrame] = []
    for i in range(rounds + 1):
        if r.isEmpty():
            break
        open_ = r.select(F.col("mine").alias("at")).distinct().withColumn("open", F.lit(True))
        w = w.join(open_, "at", "left").select("key", "at", F.col("open").isNull().alias("sure"))
        if i == rounds:
            refused.append(written(_in_order(r, w), "refused"))
            break
        laid = _last_writes(r, w)
        bad, maybe = F.coalesce(F.col("last_sure") > F.col("read_ts"), F.lit(False)), F.coalesce(F.col("last") > F.col("read_ts"), F.lit(False))
        told = written(laid.groupBy("txn_id", "mine").agg(F.max(bad).alias("bad"), F.max(maybe).alias("maybe")), "told")
        now = told.where("bad").select("txn_id", "mine")
        refused.append(now)
        settled = told.where("bad OR NOT maybe").select("txn_id", "mine")
        r_next = written(r.join(settled, ["txn_id", "mine"], "left_anti"), "reads")
        w_next = w.join(now.select(F.col("mine").alias("at")), "at", "left_anti").join(r_next.select("key").distinct(), "key", "left_semi")
        w_next = written(w_next, "writes")
        for old in (r, w):
            release(old)
        r, w = r_next, w_next
    nothing = reads.sparkSession.createDataFrame([], reads.select("txn_id", F.col("commit_ts").alias("mine")).schema)
    return reduce(DataFrame.unionByName, refused, nothing).distinct().select("txn_id", F.col("mine").alias("commit_ts"))


def _last_writes(r: DataFrame, w: DataFrame) -> DataFrame:
    """Reads with ``last`` and ``last_sure``, the last write of their key before their commit."""
    nothing = F.lit(None).cast("bigint")
    reads = r.select("key", F.col("mine").cast("bigint").alias("at"), F.lit(0).alias("kind"), "txn_id", "read_ts", "mine", nothing.alias("any"), nothing.alias("safe"))
    at = F.col("at").cast("bigint")
    none = [F.lit(None).cast(r.schema[c].dataType).alias(c) for c in ("txn_id", "read_ts", "mine")]
    writes = w.select("key", at.alias("at"), F.lit(1).alias("kind"), *none, at.alias("any"), F.when(F.col("sure"), at).alias("safe"))
    laid = running(reads.unionByName(writes), ["key"], ["at", "kind", "txn_id"], {"last": ("max", "any"), "last_sure": ("max", "safe")})
    return laid.where("kind = 0")


def _in_order(r: DataFrame, w: DataFrame) -> DataFrame:
    """``resolve`` over reads (txn_id, key, read_ts, mine) and writes (key, at): the refused, as (txn_id, mine).

    One task reads both sorted by time.  It holds the last commit of each key that is
    read, and nothing else.
    """
    rows = r.select(F.col("mine").alias("at"), F.lit(0).alias("kind"), "txn_id", "key", "read_ts")
    none = [F.lit(None).cast(r.schema[c].dataType).alias(c) for c in ("txn_id", "read_ts")]
    rows = rows.unionByName(w.select("at", F.lit(1).alias("kind"), none[0], "key", none[1]))
    kind = r.select("txn_id", "mine").schema
    return rows.repartition(1).sortWithinPartitions("at", "kind", "txn_id").mapInArrow(_settle(to_arrow_schema(kind)), kind)


def _settle(kind: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}
        at, gone, told = None, False, None
        for batch in batches:
            out = []
            for ts, write, txn, key, read_ts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ts != at:
                    at, gone, told = ts, False, None
                if write:
                    if not gone:
                        last[key] = ts
                elif last.get(key, read_ts) > read_ts and told != (txn,):
                    gone, told = True, (txn,)
                    out.append((txn, ts))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind.field(i).type) for i in (0, 1)], schema=kind)

    return run


def pruned(committed: DataFrame, min_read_ts: int) -> DataFrame:
    """Committed transactions that a later one may still conflict with."""
    return committed.where(F.col("commit_ts") > min_read_ts)


def watermark(marks: DataFrame) -> DataFrame:
    """One row ``done_until``: the greatest begun ts up to which all begun are done; 0 if none.

    ``marks`` (ts, done BOOLEAN); a ts may occur repeatedly and is open while it has
    fewer ends than begins.
    """
    by_ts = marks.where("ts IS NOT NULL").groupBy("ts").agg((F.sum(F.when(F.col("done"), -1).otherwise(1)) > 0).alias("open"))
    first_open = by_ts.where("open").agg(F.min("ts").alias("ts")).first().ts
    done = by_ts if first_open is None else by_ts.where(F.col("ts") < first_open)
    return done.agg(F.coalesce(F.max("ts"), F.lit(0)).alias("done_until"))


def recovered(log: DataFrame) -> DataFrame:
    """Records of complete batches, up to the first broken place of each log file.

    ``log`` (fid, pos, txn_ts, is_txn, is_fin, ...): records of a transaction share
    ``txn_ts`` and lie together, the last is its end mark.  A batch without an end
    mark is broken, and replay of its file stops there.  Records outside a
    transaction are batches of their own.  End marks are not returned.
    """
    batches = log.groupBy("fid", "txn_ts", "is_txn").agg(F.min("pos").alias("start"), F.max("is_fin").alias("whole"))
    broken = batches.where("is_txn AND NOT whole").groupBy("fid").agg(F.min("start").alias("stop"))
    upto = log.join(broken, "fid", "left")
    return upto.where((F.col("stop").isNull() | (F.col("pos") < F.col("stop"))) & ~F.col("is_fin")).drop("stop")


def commit_order(requests: DataFrame, order: str) -> DataFrame:
    """``requests`` with strictly increasing ``commit_ts`` from 1, in ``order``."""
    return running_sum(requests.withColumn("_one", F.lit(1)), [], [order], "_one", "_before").withColumn("commit_ts", F.col("_before") + 1).drop("_one", "_before")


def batch_sizes(entries: DataFrame, max_count: int, max_bytes: int) -> DataFrame:
    """Per transaction (txn_id): entries and bytes with 10 of overhead each, and whether it is too big."""
    sums = entries.groupBy("txn_id").agg(F.count(F.lit(1)).alias("n_entries"), F.sum(F.col("n_bytes") + 10).cast("bigint").alias("n_bytes"))
    return sums.withColumn("too_big", (F.col("n_entries") >= max_count) | (F.col("n_bytes") >= max_bytes))
