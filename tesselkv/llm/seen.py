"""Has this key been seen before?  Chains of Bloom filters that grow with the history.

Keys are spread by their hash over shards.  A shard keeps a chain of filter layers:
each layer is twice the size of the one before and has half its error rate, so the
chance that any layer of the chain errs stays below the stated bound however long
the history gets.  ``SeenStore`` keeps the chains as files, a row a shard: a new batch
is asked and added without reading the history again.  A task holds one chain and
one batch of hashes, never the keys.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselkv.files import Files
from tesselkv.operators.skew import partitions, unique_join
from tesselkv.operators.snapshot import BROADCAST_KEYS
from tesselkv.runtime import fresh, settled, shared_path, written

ERROR = 1e-3
FIRST_LAYER = 1 << 14
GROWTH, TIGHTENING, FULL = 2, 0.5, 0.5
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A second, independent hash of 64-bit hashes (the splitmix64 finaliser)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Layer:
    """A Bloom filter for ``capacity`` keys at the error rate ``error``."""

    def __init__(self, capacity: int, error: float):
        self.capacity, self.error = capacity, error
        self.k = max(1, math.ceil(-math.log2(error)))
        self.m = 64 * math.ceil(capacity * self.k / math.log(2) / 64)
        self.words = np.zeros(self.m // 64, _U)

    def _bits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = _mixed(h) | _U(1)
        for i in range(self.k):
            bit = _mixed(h + _U(i) * step) % _U(self.m)
            yield (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63))

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for word, bit in self._bits(h):
            found &= (self.words[word] & bit) != 0
        return found

    def add(self, h: np.ndarray) -> None:
        for word, bit in self._bits(h):
            np.bitwise_or.at(self.words, word, bit)

    @property
    def fill(self) -> float:
        return float(np.bitwise_count(self.words).sum()) / self.m


class Chain:
    """Layers that are added as the last one fills; ``bound`` holds for any length."""

    def __init__(self, error: float = ERROR, first: int = FIRST_LAYER):
        if not 0 < error < 1 or first < 1:
            raise ValueError("error lies between 0 and 1, and the first layer holds a key")
        self.bound, self.first = error, first
        self.layers = [Layer(first, error * (1 - TIGHTENING))]

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        for layer in reversed(self.layers):
            rest = np.flatnonzero(~found)
            if not len(rest):
                break
            found[rest] = layer.has(h[rest])
        return found

    def add(self, h: np.ndarray) -> None:
        """Adds keys in pieces, so that a layer is closed when it is half filled."""
        at = 0
        while at < len(h):
            last = self.layers[-1]
            if (fill := last.fill) >= FULL:
                last = Layer(last.capacity * GROWTH, last.error * TIGHTENING)
                self.layers.append(last)
                fill = 0.0
            # Expected keys until half the bits are set, from those set by now.
            room = math.ceil(last.m / last.k * (math.log(1 - fill) - math.log(1 - FULL)))
            last.add(h[at : at + max(1, room)])
            at += max(1, room)

    def compounded(self) -> float:
        """The bound on the error rate of the layers there are."""
        return 1 - math.prod(1 - x.error for x in self.layers)

    def dump(self) -> bytes:
        """All of the chain as bytes: a line of JSON, then the layers' words."""
        facts = {"bound": self.bound, "first": self.first, "layers": [[x.capacity, x.error] for x in self.layers]}
        return json.dumps(facts).encode() + b"\n" + b"".join(x.words.tobytes() for x in self.layers)

    @classmethod
    def load(cls, data: bytes) -> Chain:
        line = data.index(b"\n") + 1
        facts = json.loads(data[:line])
        own, at = cls(facts["bound"], facts["first"]), line
        own.layers = [Layer(*x) for x in facts["layers"]]
        for layer in own.layers:
            layer.words = np.frombuffer(data, _U, layer.m // 64, at).copy()
            at += layer.words.nbytes
        return own


def _hash(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("binary"))


def _grow(error: float, first: int):
    """Rows (shard, chain, h), a shard's old chain before its hashes, to (shard, chain)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chain = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([chain.dump()], pa.binary())], names=["shard", "chain"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            ends = [*(1 + np.flatnonzero(np.diff(shards))), len(shards)]
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                if end <= start:
                    continue
                if shards[start] != shard:
                    if chain is not None:
                        yield done()
                    shard, chain = int(shards[start]), None
                old = batch.column("chain").slice(start, 1)[0].as_py()
                if old is not None:
                    chain, start = Chain.load(old), start + 1
                chain = chain or Chain(error, first)
                h = batch.column("h").slice(start, end - start).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
                chain.add(h[~chain.has(h)])  # what it has, or seems to have, it answers already
        if chain is not None:
            yield done()

    return run


def _answer(error: float):
    """Rows (shard, chain, h, key, first_id), a shard's chain before its questions, to answers."""
    names = ["key", "h", "first_id", "maybe", "bound"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chain = None, None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            ends = [*(1 + np.flatnonzero(np.diff(shards))), len(shards)]
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                if end <= start:
                    continue
                if shards[start] != shard:
                    shard, chain = int(shards[start]), None
                held = batch.column("chain").slice(start, 1)[0].as_py()
                if held is not None:
                    chain, start = Chain.load(held), start + 1
                part = batch.slice(start, end - start)
                h = part.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
                maybe = chain.has(h) if chain else np.zeros(len(h), bool)
                bound = np.full(len(h), chain.compounded() if chain else error)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("h"), part.column("first_id"), pa.array(maybe), pa.array(bound)], names=names)

    return run


class SeenStore:
    """Chains of a growing history at ``path``: a version a batch that was added.

    The number of shards is chosen when the store is made, as many as the session's
    shuffle partitions if it is not given; a shard of ten million keys takes some 40 MB.
    """

    def __init__(self, spark: SparkSession, path: str, error: float = ERROR, first_layer: int = FIRST_LAYER, shards: int | None = None):
        self.spark, self.files = spark, Files(spark, path)
        self.files.make()
        marks = self._marks()
        if marks:
            self.state = json.loads(self.files.read(f"marks/{marks[-1]}"))
        else:
            self.state = {"version": 0, "error": error, "first": first_layer, "shards": shards or partitions(spark)}

    def _marks(self) -> list[str]:
        return [n for n in self.files.names("marks") if n.endswith(".json")]

    def _shard(self) -> Column:
        return F.pmod(F.col("h"), F.lit(self.state["shards"])).cast("int").alias("shard")

    def _chains(self) -> DataFrame | None:
        if not self.state["version"]:
            return None
        kind = "shard int, chain binary"
        return self.spark.read.schema(kind).parquet(f"{self.files.root}/chains-{self.state['version']:09}")

    def _with_chains(self, rows: DataFrame, chain_first: DataFrame | None) -> DataFrame:
        """``rows`` (shard, ...) and the chains, by shard, a shard's chain first."""
        rows = rows.withColumn("chain", F.lit(None).cast("binary"))
        if chain_first is not None:
            rows = rows.unionByName(chain_first, allowMissingColumns=True)
        return rows.repartition(self.state["shards"], "shard").sortWithinPartitions("shard", F.col("chain").isNull())

    def add(self, history: DataFrame, key: str) -> None:
        """Adds the keys of ``history``; null and empty ones are none.  Only hashes travel, each once a partition."""
        hashes = history.where(F.octet_length(key) > 0).select(_hash(key).alias("h")).select(self._shard(), "h").distinct()
        grown = self._with_chains(hashes, self._chains()).select("shard", "chain", "h")
        grown = grown.mapInArrow(_grow(self.state["error"], self.state["first"]), "shard int, chain binary")
        version = self.state["version"] + 1
        # Filters of random bits do not compress.
        grown.write.mode("overwrite").option("compression", "none").parquet(f"{self.files.root}/chains-{version:09}")
        self.state = self.state | {"version": version}
        self.files.create(f"marks/{version:09}.json", json.dumps(self.state).encode())
        for n in self._marks()[:-2]:  # readers of the version before may still be reading
            self.files.delete(f"chains-{n[:9]}")
            self.files.delete(f"marks/{n}")

    def ask(self, keys: DataFrame) -> DataFrame:
        """Columns key, h, first_id, maybe (the chain's answer) and bound (its compounded error bound).

        ``keys`` (key, first_id) has each key once.
        """
        asked = keys.select(F.col("key").cast("binary").alias("key"), _hash("key").alias("h"), F.col("first_id").cast("bigint").alias("first_id"))
        rows = self._with_chains(asked.select(self._shard(), "h", "key", "first_id"), self._chains())
        kind = "key binary, h bigint, first_id bigint, maybe boolean, bound double"
        return rows.select("shard", "chain", "h", "key", "first_id").mapInArrow(_answer(self.state["error"]), kind)


def checked(said: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """``said`` (written) with ``seen``: whether ``history`` has the key.

    A chain never denies a key that it was given, so only its yes is checked.  Up to
    ``BROADCAST_KEYS`` such keys their hashes thin the history where it is read; what is
    left is made distinct before it is shuffled, and compared by the keys themselves.
    """
    maybe = said.where("maybe")
    past = history.where(F.octet_length(key) > 0).select(F.col(key).cast("binary").alias("key"))
    if maybe.count() <= BROADCAST_KEYS:
        past = past.withColumn("h", _hash("key")).join(F.broadcast(maybe.select("h").distinct()), "h", "left_semi").drop("h")
    true = maybe.select("key").join(past.distinct(), "key", "left_semi").withColumn("seen", F.lit(True))
    return said.join(true, "key", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def first_rows(incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Each key of ``incoming`` with its first ``order``, combined before the shuffle."""
    some = incoming.where((F.octet_length(key) > 0) & F.col(order).isNotNull())
    return some.groupBy(F.col(key).alias("key")).agg(F.min(order).cast("bigint").alias("first_id"))


def judged_keys(history: DataFrame, incoming: DataFrame, key: str, order: str, error: float = ERROR, first_layer: int = FIRST_LAYER, shards: int | None = None) -> DataFrame:
    """Each key of ``incoming``: its first ``order``, and whether the history has it.

    Columns: key, first_id, maybe (the chain's answer), seen (after the exact
    check), bound (the compounded error bound of the chain that answered).  Null and
    empty keys are left out.  The chains are made here, in the shared folder; with a
    ``SeenStore`` of one's own they are kept.
    """
    spark = history.sparkSession
    store = SeenStore(spark, shared_path(spark, "chains"), error, first_layer, shards)
    store.add(history, key)
    said = written(store.ask(first_rows(incoming, key, order)), "seen")
    return checked(said, history, key).select("key", "first_id", "maybe", "seen", "bound")


def batch_reports(history: DataFrame, batches: Sequence[DataFrame], key: str, order: str, store: SeenStore) -> DataFrame:
    """Successive ``batches`` asked and added to ``store``, which holds ``history``: a row per batch.

    Columns: batch (from 0), asked, new_keys, wrong, rate, bound, within.  The exact
    check reads the history and the batches before; the chains are never made again.
    """
    rows = []
    for i, batch in enumerate(batches):
        past = reduce(DataFrame.unionByName, [x.select(F.col(key).alias("key")) for x in (history, *batches[:i])])
        said = written(store.ask(first_rows(batch, key, order)), "seen")
        rows.append(rates(checked(said, past, "key"), store.state["error"]).select(F.lit(i).alias("batch"), "*"))
        store.add(batch, key)
    return reduce(DataFrame.unionByName, rows)


def seen_before(history: DataFrame, incoming: DataFrame, key: str, order: str, error: float = ERROR) -> DataFrame:
    """Rows of ``incoming`` whose key is in ``history`` or in a row with smaller ``order``.

    Null and empty keys were never seen; rows equal in ``order`` do not precede each
    other.  Rows of one key that hold a great part of the input are spread.
    """
    k, first, seen = fresh(incoming, "k", "first_id", "seen")
    facts = judged_keys(history, incoming, key, order, error).select(F.col("key").alias(k), F.col("first_id").alias(first), F.col("seen").alias(seen))
    rows = incoming.where((F.octet_length(key) > 0) & F.col(order).isNotNull()).withColumn(k, F.col(key).cast("binary"))
    both = unique_join(settled(rows), facts, k, order)
    return both.where(F.col(seen) | (F.col(order) > F.col(first))).select(*incoming.columns)


def rates(judged: DataFrame, error: float) -> DataFrame:
    """One row: keys asked, keys new, wrong yes answers, their rate among the new, its bound, and whether it is kept."""
    wrong = F.sum((F.col("maybe") & ~F.col("seen")).cast("bigint"))
    new = F.sum((~F.col("seen")).cast("bigint"))
    row = judged.agg(F.count(F.lit(1)).alias("asked"), F.coalesce(new, F.lit(0)).alias("new_keys"), F.coalesce(wrong, F.lit(0)).alias("wrong"), F.max("bound").alias("bound"))
    rate = F.when(F.col("new_keys") > 0, F.col("wrong") / F.col("new_keys")).otherwise(F.lit(0.0))
    bound = F.coalesce("bound", F.lit(error))
    return row.select("asked", "new_keys", "wrong", rate.alias("rate"), bound.alias("bound"), (rate <= bound).alias("within"))


def error_rate(history: DataFrame, incoming: DataFrame, key: str, order: str, error: float = ERROR, first_layer: int = FIRST_LAYER) -> DataFrame:
    """One row: keys asked, keys new to the history, wrong yes answers, rate and bound.

    The rate is wrong answers over keys new to the history (0 if there are none);
    ``within`` says whether this rate, as observed, keeps to the compounded bound.
    """
    return rates(judged_keys(history, incoming, key, order, error, first_layer), error)
