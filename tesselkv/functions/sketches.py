"""Log-bucket histograms and bit-exact Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def log_bucket(number: Column) -> Column:
    """The bucket of a number, about 1 % wide."""
    return F.floor(100 * F.log(1 + F.abs(number.cast("double"))) + 0.5).cast("int")


def bucket_value(bucket: Column) -> Column:
    return F.exp(bucket / F.lit(100.0)) - 1


def log_histogram(df: DataFrame, number: str, group: Sequence[str] = ()) -> DataFrame:
    """Columns ``group``, bucket, n, total: adds up over partitions.  Nulls don't count."""
    some = df.where(F.col(number).isNotNull())
    return some.groupBy(*group, log_bucket(F.col(number)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("total"))


def histogram_percentile(histogram: DataFrame, pcts: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Columns ``group``, pct, bucket, value, from ``log_histogram``.

    The first bucket at which ``max(count * pct / 100, 1 if that is 0)`` numbers are
    reached.  A group has at most some thousand buckets, whatever its rows.
    """
    upto = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = histogram.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    wanted = sums.withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in pcts])))
    need = F.col("all") * F.col("pct") / 100
    need = F.when(need == 0, F.lit(1.0)).otherwise(need)
    first = wanted.where(F.col("upto") >= need).groupBy(*group, "pct").agg(F.min("bucket").alias("bucket"))
    return first.select(*group, "pct", "bucket", bucket_value(F.col("bucket")).alias("value"))


# Fixed values of the public Bloom hash: seed, multiplier, finishing shift.
BLOOM_SEED, BLOOM_MULTIPLIER, BLOOM_SHIFT = 0xBC9F1D34, 0xC6A4A793, 24
_LOW = 0xFFFFFFFF


def bloom_hash(data: bytes) -> int:
    """32-bit hash of bytes; all arithmetic wraps."""
    h = (BLOOM_SEED ^ (len(data) * BLOOM_MULTIPLIER)) & _LOW
    whole = len(data) & ~3
    for word in np.frombuffer(data[:whole], "<u4").tolist():
        h = (h + word) * BLOOM_MULTIPLIER & _LOW
        h ^= h >> 16
    if rest := data[whole:]:
        h = (h + int.from_bytes(rest, "little")) * BLOOM_MULTIPLIER & _LOW
        h ^= h >> BLOOM_SHIFT
    return h


def bloom_hashes(keys: Sequence[bytes]) -> np.ndarray:
    """``bloom_hash`` of each key: keys of one length are hashed together, four bytes at a step."""
    out = np.zeros(len(keys), np.int64)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(sizes, kind="stable")
    ends = [*(1 + np.flatnonzero(np.diff(sizes[order]))), len(keys)]
    multiplier, low = np.uint64(BLOOM_MULTIPLIER), np.uint64(_LOW)
    for start, end in zip([0, *ends[:-1]], ends, strict=True):
        at = order[start:end]
        if not len(at):
            continue
        n = int(sizes[at[0]])
        table = np.frombuffer(b"".join([keys[i] for i in at]), np.uint8).reshape(len(at), n)
        h = np.full(len(at), (BLOOM_SEED ^ (n * BLOOM_MULTIPLIER)) & _LOW, np.uint64)
        whole = n & ~3
        words = np.ascontiguousarray(table[:, :whole]).view("<u4").astype(np.uint64)
        for i in range(whole // 4):
            h = (h + words[:, i]) * multiplier & low
            h ^= h >> np.uint64(16)
        if n > whole:
            rest = sum(table[:, whole + i].astype(np.uint64) << np.uint64(8 * i) for i in range(n - whole))
            h = (h + rest) * multiplier & low
            h ^= h >> np.uint64(BLOOM_SHIFT)
        out[at] = h.astype(np.int64)
    return out


def bits_per_key(error: float) -> int:
    return math.ceil(-math.log2(error))


def bloom_build(hashes: Iterable[int], error: float) -> bytes:
    """A filter of key hashes: its bits, then one byte with the number of probes."""
    h = np.array(list(hashes), np.uint64)
    k = min(30, max(1, int(-math.log(error))))
    n_bytes = (max(64, len(h) * bits_per_key(error)) + 7) // 8
    field = np.zeros(n_bytes, np.uint8)
    for bit in _probes(h, k, n_bytes * 8):
        np.bitwise_or.at(field, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    return field.tobytes() + bytes([k])


def bloom_has(bloom: bytes, hashes: Sequence[int]) -> np.ndarray:
    """Whether each hash may be in the filter; a filter of no bits denies all."""
    h = np.array(hashes, np.uint64)
    if len(bloom) < 2:
        return np.zeros(len(h), bool)
    field, k = np.frombuffer(bloom[:-1], np.uint8), bloom[-1]
    found = np.ones(len(h), bool)
    for bit in _probes(h, k, len(field) * 8):
        found &= (field[bit >> 3] >> (bit & 7) & 1).astype(bool)
    return found


def _probes(h: np.ndarray, k: int, n_bits: int):
    step = (h >> np.uint64(17) | h << np.uint64(15)) & np.uint64(_LOW)
    for i in range(k):
        yield (((h + np.uint64(i) * step) & np.uint64(_LOW)) % np.uint64(n_bits)).astype(np.int64)


@pandas_udf(T.LongType())
def bloom_hash_udf(keys: pd.Series) -> pd.Series:
    """``bloom_hash`` of a binary column; null for null."""
    there = keys.notna().to_numpy()
    out = pd.Series(pd.NA, index=keys.index, dtype="Int64")
    out[there] = bloom_hashes([bytes(k) for k in keys[there]])
    return out


def bloom_filters(df: DataFrame, group: Sequence[str], key: str, error: float = 0.01) -> DataFrame:
    """Columns ``group``, bloom: one filter per group.

    A group is a sorted table, or another set of keys of bounded size: its hashes
    meet in one task (``bounded_groups`` makes such groups of any keys).
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.iloc[:1].drop(columns="h")
        return out.assign(bloom=bloom_build(sorted(set(rows["h"])), error))

    hashed = df.where(F.col(key).isNotNull()).select(*group, bloom_hash_udf(F.col(key)).alias("h"))
    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    return hashed.groupBy(*group).applyInPandas(build, f"{kinds}, bloom binary")


def bounded_groups(df: DataFrame, key: str, out: str, rows: int = 100_000) -> DataFrame:
    """``df`` with ``out``: a number, by a hash of ``key``, that about ``rows`` keys share."""
    n = max(1, -(-df.count() // rows))
    return df.withColumn(out, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def bloom_probe(keys: DataFrame, filters: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Columns ``group``, ``key``, has: what each key's own group's filter says.

    Filter and keys of a group meet in one task, the filter once; a group without a
    filter has nothing.
    """

    def probe(rows: pd.DataFrame, bloom: pd.DataFrame) -> pd.DataFrame:
        has = bloom_has(bytes(bloom["bloom"].iloc[0]), rows["h"]) if len(bloom) else np.zeros(len(rows), bool)
        return rows.drop(columns="h").assign(has=has)

    hashed = keys.where(F.col(key).isNotNull()).select(*group, key, bloom_hash_udf(F.col(key)).alias("h"))
    kinds = ", ".join(f"`{c}` {keys.schema[c].dataType.simpleString()}" for c in (*group, key))
    return hashed.groupBy(*group).cogroup(filters.groupBy(*group)).applyInPandas(probe, f"{kinds}, has boolean")
