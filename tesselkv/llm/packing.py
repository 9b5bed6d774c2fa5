"""Items of many lengths into containers of a fixed capacity.

Only the histogram of lengths is packed.  Lengths go longest first, each into the
containers with the most room left (the shortest packs); containers that are
filled alike are one pattern with a count, so the work depends on the capacity
and not on the number of items.  Items then find their place by their rank among
the items of their length.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselkv.llm.tokenize import TOKENIZERS, token_counts
from tesselkv.operators.ordered import salted_rank
from tesselkv.runtime import written

Pattern = tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """(count, pattern) pairs; a pattern lists (length, items of it), longest first.

    Lengths lie between 1 and ``capacity``.
    """
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError("lengths lie between 1 and the capacity")
    open_: dict[int, dict[Pattern, int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if not open_[room]:
            heapq.heappush(rooms, -room)
        open_[room][pattern] = open_[room].get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            room = -rooms[0] if rooms else 0
            if room < length:
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, ((length, each),), full)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            pattern, n = open_[room].popitem()
            if not open_[room]:
                heapq.heappop(rooms)
            # All take one; a single container takes as many as keep it the roomiest.
            take, each = min(n, left), 1
            if n == 1:
                next_room = room if open_[room] else (-rooms[0] if rooms else 0)
                each = max(1, min(left, (room - max(next_room, length)) // length + 1))
            if n > take:
                put(room, pattern, n - take)
            last, m = pattern[-1]
            grown = (*pattern[:-1], (last, m + each)) if last == length else (*pattern, (length, each))
            put(room - each * length, grown, take)
            left -= take * each
    return [(n, pattern) for room in sorted(open_) for pattern, n in sorted(open_[room].items())]


def places(patterns: list[tuple[int, Pattern]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: arrays (first rank, first container, items a container, offset)."""
    found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    upto: dict[int, int] = defaultdict(int)
    container = 0
    for n, pattern in patterns:
        offset = 0
        for length, m in pattern:
            found[length].append((upto[length], container, m, offset))
            upto[length] += n * m
            offset += length * m
        container += n
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in found.items()}


def pack_items(items: DataFrame, capacities: Mapping[int, int]) -> DataFrame:
    """Places for ``items`` (pack_id, item, n_tokens), with columns container, piece, start.

    An item longer than its capacity is cut into full pieces and a rest, which is
    packed like any item; all others stay whole.  An item of length 0 takes no room
    and lies at the start of container 0.  Repeated items are items of their own.
    Null lengths and unknown packs are left out.  What comes to the driver is one
    count per length: ``sum(capacities)`` numbers at most.
    """
    caps = [(int(p), int(c)) for p, c in capacities.items()]
    spark = items.sparkSession
    cap = F.create_map(*[F.lit(x) for pc in caps for x in pc]) if caps else F.create_map().cast("map<int,int>")
    rows = items.withColumn("capacity", cap[F.col("pack_id")]).where("capacity IS NOT NULL AND n_tokens IS NOT NULL")
    n_pieces = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1)).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), n_pieces - 1)))
    size = F.least(F.col("n_tokens") - F.col("piece").cast("bigint") * F.col("capacity"), F.col("capacity").cast("bigint"))
    rows = rows.select("pack_id", "item", "piece", size.alias("n_tokens"))
    histogram: dict[int, dict[int, int]] = defaultdict(dict)
    for r in rows.where("n_tokens > 0").groupBy("pack_id", "n_tokens").count().collect():
        histogram[r.pack_id][r.n_tokens] = r["count"]
    known = {p: places(shortest_pack_first(histogram[p], c)) for p, c in caps}
    sent = spark.sparkContext.broadcast(known)
    ranked = salted_rank(rows, ["pack_id", "n_tokens"], ["item", "piece"])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            container, start = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for (pack, length), at in batch.groupby(["pack_id", "n_tokens"]).indices.items():
                if length:
                    first, base, m, offset = sent.value[pack][length]
                    rank = batch["rank"].to_numpy()[at]
                    k = np.searchsorted(first, rank, "right") - 1
                    whole, slot = np.divmod(rank - first[k], m[k])
                    container[at], start[at] = base[k] + whole, offset[k] + slot * length
            yield batch[["pack_id", "item", "piece"]].assign(container=container, start=start, n_tokens=batch["n_tokens"])

    kind = items.schema["item"].dataType.simpleString()
    return ranked.mapInPandas(find, f"pack_id int, item {kind}, piece int, container bigint, start bigint, n_tokens bigint")


def pack_documents(docs: DataFrame, packs: DataFrame, doc_id: str, text: str, folder: str = TOKENIZERS) -> DataFrame:
    """Container and place of each non-empty document for every row of ``packs``.

    ``packs`` (pack_id, tokenizer, capacity) is small and fixed; rows with a null or
    a capacity below 1 are left out.
    """
    wanted = [r for r in packs.collect() if None not in (r.pack_id, r.tokenizer, r.capacity) and r.capacity > 0]
    names = sorted({r.tokenizer for r in wanted})
    counts = written(token_counts(docs, doc_id, text, names, folder), "tokens")
    of = F.explode(F.array(*[F.struct(F.lit(r.pack_id).cast("int").alias("pack_id"), F.lit(r.tokenizer).alias("name")) for r in wanted])) if wanted else F.explode(F.array().cast("array<struct<pack_id:int,name:string>>"))
    items = counts.withColumn("p", of).where("p.name = tokenizer").select("p.pack_id", F.col(doc_id).alias("item"), "n_tokens")
    return pack_items(items, {r.pack_id: r.capacity for r in wanted}).withColumnRenamed("item", doc_id)


def use(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack: documents' pieces, containers, tokens, and the share of room used."""
    each = packed.groupBy("pack_id", "container").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start") + F.col("n_tokens")).alias("end"))
    whole = each.join(F.broadcast(packs.select("pack_id", "capacity")), "pack_id").groupBy("pack_id")
    sums = whole.agg(F.sum("n").alias("pieces"), F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"), F.max(F.col("end") - F.col("tokens")).alias("gaps"), F.max("end").alias("longest"))
    share = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6)
    return sums.select("pack_id", "pieces", "containers", "tokens", share.alias("share_used"), (F.col("gaps") == 0).alias("no_gaps"), (F.col("longest") <= F.col("capacity")).alias("fits"))
