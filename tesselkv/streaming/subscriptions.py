"""Change subscriptions by prefix and wildcard, and change feeds as streams."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesselkv import schema as S
from tesselkv.errors import BadIgnoreRange
from tesselkv.operators.changefeed import UPSERT, existing, latest_changes
from tesselkv.files import Files


def parse_ignore(text: str) -> list[bool]:
    """Places of a prefix that match any byte: "0, 3-5, 7" -> [T, F, F, T, T, T, F, T].

    Blanks don't matter, "" ignores nothing.
    """
    marked: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, dash, high = (x.strip() for x in part.partition("-"))
        if not low.isdigit() or (dash and not high.isdigit()):
            raise BadIgnoreRange(f"can't read {part!r}")
        if int(high or low) < int(low):
            raise BadIgnoreRange(f"{part!r} runs backwards")
        marked.update(range(int(low), int(high or low) + 1))
    return [i in marked for i in range(max(marked, default=-1) + 1)]


@dataclass(frozen=True)
class Subscription:
    """Keys that start with ``prefix``, bytes at ``ignore`` matching anything."""

    id: int
    prefix: bytes
    ignore: str = ""

    def matches(self, key: str = "user_key") -> Column:
        wild = parse_ignore(self.ignore)
        wild += [False] * (len(self.prefix) - len(wild))
        if not any(wild[: len(self.prefix)]):
            return S.in_prefix(self.prefix, key) if self.prefix else F.col(key).isNotNull()
        found = F.octet_length(key) >= len(self.prefix)
        start = 0
        while start < len(self.prefix):  # one comparison for each run of literal bytes
            end = start + 1
            while end < len(self.prefix) and wild[end] == wild[start]:
                end += 1
            if not wild[start]:
                found = found & (F.substring(F.col(key), start + 1, end - start) == S.key_bytes(self.prefix[start:end]))
            start = end
        return found & F.col(key).isNotNull()


def matching(subscriptions: Sequence[Subscription], key: str = "user_key") -> Column:
    """Ids of the subscriptions that a key matches, in ascending order, each once."""
    hits = [F.when(s.matches(key), F.lit(s.id).cast("bigint")) for s in subscriptions]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))) if hits else F.array().cast("array<bigint>")


def published(records: DataFrame, subscriptions: Sequence[Subscription]) -> DataFrame:
    """Change events: a row for each record and subscription that it matches.

    Internal keys are hidden.  Works on batch and streaming DataFrames alike.
    """
    shown = records.where(~S.in_prefix(S.RESERVED_PREFIX))
    events = shown.withColumn("subscription", F.explode(matching(subscriptions)))
    keep = [c for c in ("user_key", "value", "user_meta", "version", "expires_at", "meta", "stream_id") if c in records.columns]
    return events.select("subscription", *keep)


class Registry:
    """Subscriptions that may be added and removed while a stream runs; each batch takes those of its time."""

    def __init__(self, subscriptions: Sequence[Subscription] = ()):
        self._held = {s.id: s for s in subscriptions}
        self._mutex = threading.Lock()

    def add(self, prefix: bytes, ignore: str = "") -> int:
        """The new subscription's id."""
        parse_ignore(ignore)
        with self._mutex:
            number = 1 + max(self._held, default=0)
            self._held[number] = Subscription(number, prefix, ignore)
            return number

    def remove(self, number: int) -> None:
        with self._mutex:
            self._held.pop(number, None)

    def current(self) -> list[Subscription]:
        with self._mutex:
            return list(self._held.values())


def subscribe(
    changes: DataFrame,
    subscriptions: Sequence[Subscription] | Registry,
    callback: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Calls back with each batch of events; a callback that fails ends the subscription.

    A batch may come again after a failure, under the same number.
    """
    registry = subscriptions if isinstance(subscriptions, Registry) else Registry(subscriptions)

    def publish(batch: DataFrame, batch_id: int) -> None:
        callback(published(batch, registry.current()), batch_id)

    writer = changes.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class StateTable:
    """The last change of every key, deletes included, kept current from a feed.

    A batch adds its own last changes as one more part; every ``MERGE_AT`` parts all are
    merged into one, so a batch costs its own size and, spread over batches, a share of
    the table.  A mark names the parts and the last batch, so a batch that comes again
    is skipped.  Files of marks before the last merge but one are removed.
    """

    MERGE_AT = 16

    def __init__(self, path: str, key: str, seq: str, op: str):
        self.path, self.key, self.seq, self.op = path, key, seq, op

    def _marks(self, files: Files) -> list[str]:
        return [n for n in files.names("marks") if n.endswith(".json")]

    def _current(self, files: Files) -> dict:
        names = self._marks(files)
        return json.loads(files.read(f"marks/{names[-1]}")) if names else {"batch": -1, "parts": []}

    def _rows(self, spark: SparkSession, files: Files, parts: Sequence[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [spark.read.parquet(f"{files.root}/{p}") for p in parts])

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = Files(spark, self.path)
        now = self._current(files)
        if batch_id <= now["batch"]:
            return
        files.make()
        part = f"part-{batch_id:012}"
        last = latest_changes(batch, self.key, self.seq, self.op)
        parts = [*now["parts"], part]
        if len(parts) > self.MERGE_AT:
            merged = self._rows(spark, files, now["parts"]).unionByName(last)
            last, parts = latest_changes(merged, self.key, self.seq, self.op), [part]
        last.write.mode("overwrite").parquet(f"{files.root}/{part}")
        files.create(f"marks/{batch_id:012}.json", json.dumps({"batch": batch_id, "parts": parts}).encode())
        if parts == [part]:
            self._tidy(files)

    def _tidy(self, files: Files) -> None:
        """Readers of the mark before this one may still be reading; of older ones not."""
        names = self._marks(files)
        used = {p for n in names[-2:] for p in json.loads(files.read(f"marks/{n}"))["parts"]}
        for n in names[:-2]:
            files.delete(f"marks/{n}")
        for n in files.names(""):
            if n.startswith("part-") and n not in used:
                files.delete(n)

    def read(self, spark: SparkSession) -> DataFrame:
        """Rows that exist now."""
        files = Files(spark, self.path)
        parts = self._current(files)["parts"]
        if not parts:
            raise ValueError("no batch was applied yet")
        rows = self._rows(spark, files, parts)
        return existing(latest_changes(rows, self.key, self.seq, self.op), self.op).withColumn(self.op, F.lit(UPSERT)).select(*rows.columns)
