"""The store: a log of commits, sorted tables in levels, a value log and a manifest.

Data are Parquet files.  Everything that changes the set of files writes the new
files first and then one new manifest, which appears by a rename; readers load one
manifest and see exactly its files.  One process writes at a time (``Lease``); its
threads may share the store.  Files that are replaced stay until no transaction
that was open then is open any more, and ``Config.file_retention`` has passed.
"""

from __future__ import annotations

import re
import threading
import time
from collections import Counter
from collections.abc import Callable, Collection, Sequence
from dataclasses import asdict, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselkv import errors as E
from tesselkv import schema as S
from tesselkv.operators import integrity, retention, snapshot, tables, values
from tesselkv.operators.merge import merge_sources, overlay
from tesselkv.plans import levels as L
from tesselkv.store.config import Config
from tesselkv.files import Files
from tesselkv.store.keyring import Keyring
from tesselkv.store.lease import Lease
from tesselkv.store.manifest import Manifest
from tesselkv.store.oracle import KeyRange, Oracle
from tesselkv.store.txn import Entry, Item, Txn
from tesselkv.streaming.subscriptions import Registry, Subscription, subscribe
from tesselkv.streaming.thresholds import ThresholdTracker

_REFUSED = "ingest refused: "


class Store:
    """Opens or makes a store at ``root``."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, now: Callable[[], int] | None = None):
        self.spark, self.config = spark, (config or Config()).checked()
        self.now = now or (lambda: int(time.time()))
        self.files = Files(spark, root)
        self.files.make()
        self.lease = Lease(self.files, self.config.lease, self.config.read_only)
        self.closed, self.metrics, self.busy = False, Counter(), L.InFlight()
        self._mutex = threading.RLock()  # one change of the manifest at a time
        self._holders: dict[int, int] = {}  # open transactions and the manifest they began with
        try:
            self.keys = Keyring(spark, self.files, self.config.encryption_key, self.config.key_rotation)
            self.manifest = Manifest(self.files)
            if not self.config.read_only:
                self._revert()
                self._next_id = self.state["next_id"]
        except BaseException:
            self.lease.end()
            raise
        if self.config.encryption_key:
            self._hide_keys()
        self.oracle = Oracle(self.state["max_version"], self.config.detect_conflicts, self.config.managed_txns)
        most = min(1 << 20, self.config.max_batch_size)
        self.sizes_seen = ThresholdTracker(self.config.value_percentile, self.config.value_threshold, max(most, self.config.value_threshold))

    # Manifest and files

    @property
    def state(self) -> dict:
        return self.manifest.state

    def _swap(self, **changes) -> None:
        self.lease.check()
        self.manifest.swap(**changes)

    def _ids(self, n: int) -> int:
        """The first of ``n`` table ids that nobody has."""
        with self._mutex:
            self._next_id += n
            return self._next_id - n

    def _revert(self) -> None:
        """Files the manifest doesn't know are left-overs; files it misses are an error."""
        known = [t["path"] for t in self.state["tables"]] + [c["path"] for c in self.state["log"]] + [v.split("#")[0] for v in self.state["vlog"]]
        if missing := [p for p in known if not self.files.exists(p)]:
            raise E.ManifestError(f"missing: {missing[:3]}")
        kept = {"/".join(p.split("/")[:2]) for p in [*known, *[r["path"] for r in self.state["retired"]]]}
        self.files.delete("staging")
        for folder in ("sst", "vlog"):  # not the log, which subscribers may still read
            for name in self.files.names(folder):
                if f"{folder}/{name}" not in kept:
                    self.files.delete(f"{folder}/{name}")

    def hold(self, txn: Txn) -> None:
        with self._mutex:
            self._holders[id(txn)] = self.state["version"]

    def let_go(self, txn: Txn) -> None:
        with self._mutex:
            self._holders.pop(id(txn), None)

    def _retired(self, paths: Sequence[str]) -> list[dict]:
        """The manifest's list of replaced files with ``paths``, which the next version replaces."""
        at = int(time.time())
        return [*self.state["retired"], *[{"path": p, "version": self.state["version"] + 1, "at": at} for p in paths]]

    def remove_retired(self) -> list[str]:
        """Deletes replaced files that no open transaction began with, once their retention has passed."""
        with self._mutex:
            oldest, now = min(self._holders.values(), default=None), time.time()
            due = [r for r in self.state["retired"] if now - r["at"] >= self.config.file_retention and (oldest is None or oldest >= r["version"])]
            if due:
                self._swap(retired=[r for r in self.state["retired"] if r not in due])
        for r in due:
            self.files.delete(r["path"])
        return [r["path"] for r in due]

    def _hide_keys(self) -> None:
        """Data keys are literals of plans: plans are shown and logged without them."""
        name, own = "spark.sql.redaction.string.regex", r"(?is)aes_?(en|de)crypt\(.*?\)+"
        old = self.spark.conf.get(name, None)
        if own not in (old or ""):
            self.spark.conf.set(name, f"{old}|{own}" if old else own)

    def close(self) -> None:
        if not self.closed:
            if not self.config.read_only:
                self.remove_retired()
            self.closed = True
            self.lease.end()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _writable(self) -> None:
        if self.closed:
            raise E.StoreClosed("the store is closed")
        if self.config.read_only:
            raise E.ReadOnlyTxn("the store was opened to read")

    # Namespaces

    def ban_namespace(self, number: int) -> None:
        self._writable()
        with self._mutex:
            self._swap(banned=sorted({*self.state["banned"], number}))

    def check_ban(self, key: bytes) -> None:
        at = self.config.namespace_offset
        if at is not None and len(key) > at + 8 and int.from_bytes(key[at : at + 8], "big", signed=True) in self.state["banned"]:
            raise E.BannedKey(repr(key))

    # Writes

    def update(self, work: Callable[[Txn], None]) -> int | None:
        """Runs ``work`` in a transaction and commits it; always ends it."""
        txn = Txn(self)
        try:
            work(txn)
            return txn.commit()
        finally:
            txn.discard()

    def txn(self, update: bool = True) -> Txn:
        return Txn(self, update)

    def txn_at(self, read_ts: int) -> Txn:
        if not self.config.managed_txns:
            raise E.BadConfig("only managed transactions choose their version")
        return Txn(self, True, read_ts)

    def set_discard_ts(self, ts: int) -> None:
        """Managed transactions: no reader needs versions hidden at or below ``ts`` any more."""
        if not self.config.managed_txns:
            raise E.BadConfig("only managed transactions set what may be discarded")
        self.oracle.set_discard_ts(ts)

    def append(self, ts: int, entries: Sequence[Entry]) -> None:
        """One commit as one batch: readers see all of it or nothing."""
        rows = [(bytearray(e.key), e.version or ts, bytearray(e.value), e.expires_at, e.user_meta, e.meta | S.TXN, None) for e in entries]
        self.metrics["puts"] += len(rows)
        self.metrics["bytes_user"] += sum(len(e.key) + len(e.value) for e in entries)
        self._log(ts, self.spark.createDataFrame(rows, S.KV))

    def ingest(self, df: DataFrame) -> int:
        """A DataFrame of keys and values (and what else of the record it has) as one commit.

        A row that a transaction could not write refuses the commit with the same error.
        Of several rows of one key one is kept when the log is flushed; give one a key.
        """
        self._writable()
        ts = self.oracle.commit_ts(self.oracle.next_ts - 1, (), ())
        default = {"expires_at": F.lit(0), "user_meta": F.lit(0), "meta": F.lit(0), "value": F.lit(None)}
        kinds = {f.name: f.dataType for f in S.KV}
        cols = [(F.col(c) if c in df.columns else default[c]).cast(kinds[c]).alias(c) for c in ("user_key", "value", "expires_at", "user_meta", "meta")]
        rows = df.select(*cols).withColumn("version", F.lit(ts)).withColumn("vptr", F.lit(None).cast(S.VPTR)).select(*S.KV_COLUMNS)
        rows = rows.withColumn("meta", F.col("meta").bitwiseOR(F.lit(S.TXN)).cast("smallint"))
        # Judged while it is written, so that what is judged is what is stored: a refused job commits no file.
        error = S.write_error(self.config.vlog_file_size, self.state["banned"], self.config.namespace_offset)
        refuse = F.raise_error(F.concat(F.lit(_REFUSED), error, F.lit("."))).cast("binary")
        rows = rows.withColumn("user_key", F.when(error.isNull(), F.col("user_key")).otherwise(refuse))
        try:
            self._log(ts, rows, bulk=True)
        except PySparkException as e:
            found = re.search(rf"{_REFUSED}(\w+)\.", str(e))
            if not found:
                raise
            raise getattr(E, found[1])("a row of the ingest can't be written") from e
        finally:
            self.oracle.done_commit(ts)
        return ts

    def check_ingested(self, read_ts: int, reads: Collection[bytes], ranges: Sequence[KeyRange] = ()) -> None:
        """Raises ``Conflict`` if a bulk commit newer than ``read_ts`` wrote a key of ``reads`` or ``ranges``.

        The keys read go to the bulk commits' files, not the other way.  The files stay
        in the log after a flush, until ``truncate_log`` finds no transaction that needs them.
        """
        paths = self.oracle.ingested_since(read_ts) if reads or ranges else []
        if not paths:
            return
        written = self.spark.read.schema(S.KV).parquet(*[f"{self.files.root}/{p}" for p in paths]).select("user_key")
        met = False
        if reads:
            asked = self.spark.createDataFrame([(bytearray(k),) for k in reads], "user_key binary")
            met = bool(written.join(F.broadcast(asked), "user_key", "left_semi").head(1))
        met = met or any(written.where(S.in_range(*r)).head(1) for r in ranges)
        if met:
            raise E.Conflict("a key that was read has been ingested since")

    def _log(self, ts: int, rows: DataFrame, bulk: bool = False) -> None:
        self._writable()
        path, key_id = f"log/commit-{ts:020}", self.keys.latest(self.now())
        staged = f"staging/commit-{ts:020}"  # tasks of a refused job may still write there for a while
        self._sealed(rows, key_id).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.files.root}/{staged}")
        self.files.make("log")
        if not self.files.rename(staged, path):
            raise E.ManifestError(f"{path} is there already")
        commit = {"path": path, "ts": ts, "key": key_id, "size": self.files.size(path)}
        with self._mutex:
            if bulk and self.oracle.detect:
                self.oracle.ingested[ts] = path
            self._swap(log=[*self.state["log"], commit], max_version=max(self.state["max_version"], ts))
            held = self.state["log"]
            if len(held) >= self.config.log_commits or sum(c["size"] for c in held) >= self.config.levels.memtable_size:
                self.flush()

    # Values at rest

    def _sealed(self, df: DataFrame, key_id: int) -> DataFrame:
        key = self.keys.data_key(key_id)
        return df if key is None else df.withColumn("value", integrity.encrypted(F.col("value"), F.lit(key)))

    def _read(self, path: str, key_id: int, kind=S.KV) -> DataFrame:
        df = self.spark.read.schema(kind).parquet(f"{self.files.root}/{path}")
        key = self.keys.data_key(key_id)
        return df if key is None else df.withColumn("value", integrity.decrypted(F.col("value"), F.lit(key)))

    # Reads

    def _sources(self, key: bytes | None = None, within: KeyRange | None = None) -> list[DataFrame]:
        """Newest first: commits, then level 0 by age, then deeper levels; only what may hold the key or range."""
        sources, state = [], self.state
        by_key = sorted(state["log"], key=lambda c: -c["ts"])
        for key_id in dict.fromkeys(c["key"] for c in by_key):
            sources.append(reduce(DataFrame.unionByName, [self._read(c["path"], key_id) for c in by_key if c["key"] == key_id]))
        low, high = (key, key + b"\0") if key is not None else within or (None, None)
        held = [
            t for t in state["tables"]
            if (low is None or t["biggest"] >= low.hex()) and (high is None or t["smallest"] < high.hex())
        ]
        self.metrics["tables_read"] += len(held)
        self.metrics["tables_pruned"] += len(state["tables"]) - len(held)
        for level, n in Counter(t["level"] for t in held).items():
            self.metrics[f"level{level}_{'gets' if key is not None else 'scans'}"] += n
        for t in sorted((t for t in held if t["level"] == 0), key=lambda t: -t["id"]):
            sources.append(self._read(t["path"], t["key"]))
        for level in range(1, self.config.levels.levels):
            for key_id in dict.fromkeys(t["key"] for t in held if t["level"] == level):
                paths = [f"{self.files.root}/{t['path']}" for t in held if t["level"] == level and t["key"] == key_id]
                df, data_key = self.spark.read.schema(S.KV).parquet(*paths), self.keys.data_key(key_id)
                sources.append(df if data_key is None else df.withColumn("value", integrity.decrypted(F.col("value"), F.lit(data_key))))
        if key is not None:
            return [s.where(F.col("user_key") == S.key_bytes(key)) for s in sources]
        return [s.where(S.in_range(low, high)) for s in sources] if within else sources

    def records(self, key: bytes | None = None, resolve: bool = True, within: KeyRange | None = None) -> DataFrame:
        """Every version held, each once; large values read back if ``resolve``."""
        if self.closed:
            raise E.StoreClosed("the store is closed")
        sources = self._sources(key, within)
        if not sources:
            return self.spark.createDataFrame([], S.KV)
        merged = merge_sources(sources)
        return self._resolved(merged) if resolve else merged

    def _value_files(self, fid: int | None = None) -> list[str]:
        """Entries of the value log, all or those that may hold the file ``fid``."""
        def may(v: str) -> bool:
            parts = v.split("#")
            return fid is None or len(parts) < 4 or int(parts[2]) <= fid <= int(parts[3])

        return [v for v in self.state["vlog"] if may(v)]

    def _values(self, entries: Sequence[str]) -> DataFrame:
        parts = [self._read(v.split("#")[0], int(v.split("#")[1]), "fid int, offset int, value binary") for v in entries]
        return reduce(DataFrame.unionByName, parts)

    def _resolved(self, kv: DataFrame) -> DataFrame:
        entries = self._value_files()
        return values.resolved(kv, self._values(entries)).select(*S.KV_COLUMNS) if entries else kv

    def get(self, key: bytes, read_ts: int | None = None, now: int | None = None) -> Item | None:
        """The visible record; of the value log only the files of its pointer are read."""
        self.metrics["gets"] += 1
        chosen = snapshot.snapshot(self.records(key, resolve=False), self.now() if now is None else now, read_ts)
        row = chosen.first()
        self.metrics["gets_with_result"] += row is not None
        if row is None:
            return None
        value = row.value
        if row.vptr is not None and row.meta & S.VALUE_POINTER:
            entries = self._value_files(row.vptr.fid)
            self.metrics["value_files_read"] += len(entries)
            at = (F.col("fid") == row.vptr.fid) & (F.col("offset") == row.vptr.offset)
            found = self._values(entries).where(at).first() if entries else None
            value = found.value if found else value
        return Item(bytes(row.user_key), bytes(value or b""), row.version, row.user_meta, row.expires_at)

    def scan(
        self,
        read_ts: int | None = None,
        within: Column | KeyRange | None = None,
        reverse: bool = False,
        limit: int | None = None,
        now: int | None = None,
        pending: DataFrame | None = None,
    ) -> DataFrame:
        """Visible records in key order.

        ``within`` is a (start, end) of keys, which leaves out tables by the manifest, or a
        condition on the key.  Rows of ``pending`` (one per key) stand before the store's.
        """
        span = within if isinstance(within, tuple) else None
        limits = S.in_range(*within) if isinstance(within, tuple) else within
        base = self.records(resolve=False, within=span)
        base = base if limits is None else base.where(limits)
        chosen = snapshot.newest(base, read_ts)
        if pending is not None:
            chosen = overlay(pending if limits is None else pending.where(limits), chosen)
        chosen = chosen.where(~S.gone(self.now() if now is None else now))
        order = F.col("user_key").desc() if reverse else F.col("user_key").asc()
        if limit is not None:
            chosen = chosen.orderBy(order).limit(limit)
        return self._resolved(chosen).orderBy(order)

    def beside(self, key: bytes) -> tuple[bytes | None, bytes | None, bytes | None]:
        """The keys before and after ``key``, and the last of all, hidden ones too."""
        row = snapshot.beside(self.records(resolve=False), key).first()
        return tuple(None if x is None else bytes(x) for x in row)

    def multi_get(self, lookups: DataFrame, now: int | None = None) -> DataFrame:
        return snapshot.multi_get(lookups, self.records(), self.now() if now is None else now)

    # Levels

    def _write_tables(self, kv: DataFrame, level: int, parts: int, cuts: Sequence[bytes] = ()) -> list[dict]:
        """Sorted, range-partitioned Parquet; each file is a table.

        Ranges are of (key, version), so a key of very many versions is several tables,
        which are neighbours.  No table crosses one of ``cuts``.  A column ``stale`` in
        ``kv`` is the bytes that only hide what lies below, summed per table.
        """
        with_stale = "stale" in kv.columns
        out = kv.withColumn("_stale", F.col("stale").cast("bigint") if with_stale else F.lit(0).cast("bigint"))
        if cuts:  # ascending, and no more than tables of the level below by ten
            upto = F.lit(0)
            for i, cut in enumerate(cuts):
                upto = F.when(F.col("user_key") > S.key_bytes(cut), i + 1).otherwise(upto)
            out = out.withColumn("_cut", upto)
        out = out.select(*S.KV_COLUMNS, "_stale", *(["_cut"] if cuts else []))
        out = out.persist(StorageLevel.DISK_ONLY)  # ranges are sampled before rows are sent
        key_id, first = self.keys.latest(self.now()), self._ids(1)
        folder, order = f"sst/{first:012}-{level}", [*(["_cut"] if cuts else []), "user_key", F.col("version").desc()]
        try:
            ranged = out.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            writer = self._sealed(ranged, key_id).write.mode("overwrite").option("compression", integrity.CODECS[self.config.compression])
            if self.config.bloom:
                # Sized for the rows a file will hold, not the format's default of a megabyte.
                writer = writer.option("parquet.bloom.filter.enabled#user_key", "true")
                writer = writer.option("parquet.bloom.filter.expected.ndv#user_key", str(self.config.output_rows))
            (writer.partitionBy("_cut") if cuts else writer).parquet(f"{self.files.root}/{folder}")
        finally:
            out.unpersist()
        read = self.spark.read.schema("user_key binary, version bigint, _stale bigint").parquet(f"{self.files.root}/{folder}")
        stats = read.groupBy(F.input_file_name().alias("file")).agg(
            F.min("user_key").alias("smallest"), F.max("user_key").alias("biggest"), F.count(F.lit(1)).alias("key_count"),
            F.max("version").alias("max_version"), F.sum("_stale").alias("stale"),
        ).collect()  # a row a file
        if not stats:
            self.files.delete(folder)
            return []
        first, found = self._ids(len(stats)), []
        for i, r in enumerate(sorted(stats, key=lambda r: (bytes(r.smallest), bytes(r.biggest), -r.max_version))):
            path = folder + r.file.partition(folder.split("/")[1])[2]
            found.append({
                "id": first + i, "level": level, "path": path, "smallest": bytes(r.smallest).hex(), "biggest": bytes(r.biggest).hex(),
                "size": self.files.size(path), "key_count": r.key_count, "max_version": r.max_version, "stale": r.stale,
                "created_at": self.now(), "key": key_id,
            })
        return found

    def flush(self, drop_prefixes: Sequence[bytes] = ()) -> list[dict]:
        """The commits of the log become level 0 tables; large values go to the value log.

        A memtable's bytes make a table.  Keys under ``drop_prefixes`` are left out.
        """
        self._writable()
        with self._mutex:
            if sum(t["level"] == 0 for t in self.state["tables"]) >= self.config.levels.level0_stall:
                self.compact()
            if not self.state["log"]:
                return []
            done = self.state["log"]
            kv = merge_sources([reduce(DataFrame.unionByName, [self._read(c["path"], c["key"]) for c in done])])
            for prefix in drop_prefixes:
                kv = kv.where(~S.in_prefix(prefix))
            vlog, first = self.state["vlog"], self._next_fid()
            after = first
            threshold = self._threshold(kv)
            if kv.where(F.octet_length("value") >= threshold).head(1):
                kv, log = values.separated(kv, threshold, self.config.vlog_file_size, ["user_key", "version"], self.config.vlog_max_entries)
                moved = F.col("vptr").withField("fid", F.col("vptr.fid") + first)
                kv = kv.withColumn("vptr", F.when(F.col("vptr").isNotNull(), moved))
                log = log.withColumn("fid", F.col("fid") + first).withColumn("len", F.octet_length("value"))
                entry, after = self._write_values(log.sortWithinPartitions("fid", "offset"))
                vlog = [*vlog, entry]
            parts = max(1, -(-sum(c["size"] for c in done) // self.config.levels.memtable_size))
            made = self._write_tables(kv, 0, parts)
            log_left = [c for c in self.state["log"] if c not in done]
            self._swap(tables=[*self.state["tables"], *made], log=log_left, vlog=vlog, next_id=self._next_id, next_fid=after)
        self.metrics["bytes_level0"] += sum(t["size"] for t in made)
        self.remove_retired()
        return made

    def _write_values(self, log: DataFrame) -> tuple[str, int]:
        """Writes entries (fid, offset, len, value): (the value log's new entry, the next free fid)."""
        key_id, name = self.keys.latest(self.now()), f"vlog/values-{self._ids(1):012}"
        self._sealed(log, key_id).write.mode("overwrite").parquet(f"{self.files.root}/{name}")
        read = self.spark.read.schema("fid int, offset int, len int").parquet(f"{self.files.root}/{name}")
        end = F.max(F.col("offset").cast("bigint") + F.col("len"))
        r = read.agg(F.min("fid").alias("lo"), F.max("fid").alias("hi"), end.alias("end")).first()
        if (r.end or 0) > values.MOST_BYTES:
            raise E.ValueLogSize("a value log file would be longer than its offsets reach")
        return f"{name}#{key_id}#{-1 if r.lo is None else r.lo}#{-1 if r.hi is None else r.hi}", 1 + (-1 if r.hi is None else r.hi)

    def _next_fid(self) -> int:
        """The first value log file id that no flush has used.

        Manifests from before it was kept there gave each flush 10,000 ids, or more if it needed more.
        """
        if "next_fid" in self.state and (self.state["next_fid"] or not self.state["vlog"]):
            return self.state["next_fid"]
        vlog = self.state["vlog"]
        base = 1 + max(int(v.split("/")[1].split("-")[1].split("#")[0]) for v in vlog)
        paths = [f"{self.files.root}/{v.split('#')[0]}" for v in vlog]
        greatest = self.spark.read.schema("fid int").parquet(*paths).agg(F.max("fid").alias("fid")).first().fid
        return max(base * 10_000, -1 if greatest is None else greatest + 1)

    def _threshold(self, kv: DataFrame) -> int:
        """The least size of a value kept apart: it follows the sizes of all flushes since the store was opened."""
        if not self.config.value_percentile:
            return self.config.value_threshold
        sized = kv.select(F.octet_length("value").alias("size")).where("size IS NOT NULL")
        self.sizes_seen.observe(sized, self.sizes_seen.last_batch + 1)
        return self.sizes_seen.threshold

    def table_info(self) -> DataFrame:
        kinds = "table_id bigint, level int, smallest binary, biggest binary, key_count bigint, max_version bigint, on_disk_size bigint, stale_data_size bigint, created_at bigint"
        rows = [(t["id"], t["level"], bytearray.fromhex(t["smallest"]), bytearray.fromhex(t["biggest"]), t["key_count"], t["max_version"], t["size"], t["stale"], t["created_at"]) for t in self.state["tables"]]
        return tables.listing(self.spark.createDataFrame(rows, kinds))

    def _tables(self) -> list[L.Table]:
        return [L.Table(t["id"], t["level"], bytes.fromhex(t["smallest"]), bytes.fromhex(t["biggest"]), t["size"], t["max_version"], t["stale"], t["created_at"]) for t in self.state["tables"]]

    def priorities(self) -> tuple[L.Targets, list[L.Priority]]:
        sizes = [sum(t["size"] for t in self.state["tables"] if t["level"] == i) for i in range(self.config.levels.levels)]
        targets = L.level_targets(sizes, self.config.levels)
        return targets, L.priorities(sizes, sum(t["level"] == 0 for t in self.state["tables"]), targets, self.config.levels)

    def _plan(self, worker: int = 0, tick: int = 0) -> L.Plan | None:
        """The first compaction that can be had, in the worker's order; the last level's own after all others."""
        held, now, last = self._tables(), self.now(), self.config.levels.levels - 1
        targets, wanted = self.priorities()
        for p in L.work_order(wanted, worker, tick, last, lmax=True):
            if plan := L.choose_for(held, p, targets, self.busy, now, self.oracle.discard_ts(), worker, last + 1):
                return plan
        return L.choose_last(held, last, targets, self.busy, now, self.oracle.discard_ts())

    def compact(self, force: bool = False, drop_prefixes: Sequence[bytes] = (), worker: int = 0, tick: int = 1) -> list[dict]:
        """The most urgent compaction, or of all tables into the last level if ``force``."""
        self._writable()
        with self._mutex:
            if force:
                held, last = self._tables(), self.config.levels.levels - 1
                r = L.Range.of(held)
                plan = L.Plan(0, last, tuple(t for t in held if t.level < last), tuple(t for t in held if t.level == last), r, r) if held else None
                if plan and not self.busy.take(plan):
                    raise E.FillTables("another compaction is running")
            else:
                plan = self._plan(worker, tick)
        if not plan:
            return []
        try:
            return self._run(plan, self.now(), drop_prefixes)
        finally:
            with self._mutex:
                self.busy.release(plan)

    def maintain(self, most: int = 1000) -> int:
        """Compacts until nothing is wanted, ``most`` times at most; how often."""
        for n in range(most):
            before = self.state["version"]
            self.compact(tick=n + 1)
            if self.state["version"] == before:
                return n
        return most

    def _run(self, plan: L.Plan, now: int, drop_prefixes: Sequence[bytes]) -> list[dict]:
        by_id = {t["id"]: t for t in self.state["tables"]}
        used = [by_id[t.table_id] for t in sorted(plan.inputs, key=lambda t: (t.level, -t.table_id))]
        ids = {t["id"] for t in used}
        under = [t for t in used if any(bytes.fromhex(t["smallest"]).startswith(p) and bytes.fromhex(t["biggest"]).startswith(p) for p in drop_prefixes)]
        span = plan.this_range.union(plan.next_range)
        # Deeper tables hold older versions; so may neighbours that share a key of many versions.
        rest = [t for t in self._tables() if t.table_id not in ids]
        beside = {0} if plan.next_level == 0 else {plan.this_level, plan.next_level} - {0}
        others = [t for t in rest if t.level > plan.next_level or t.level in beside]
        overlap = any(span.overlaps(L.Range(t.smallest, t.biggest)) for t in others)
        read = [self._read(t["path"], t["key"]) for t in used if t not in under]
        made, freed = [], {}
        if read:
            judged = retention.judged(merge_sources(read), now, self.oracle.discard_ts(), self.config.num_versions_to_keep, overlap, drop_prefixes)
            judged = judged.persist(StorageLevel.DISK_ONLY)
            try:
                freed = {str(r.fid): r.bytes for r in retention.discard_stats(judged).collect()}  # a row a value log file
                size = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 12
                kept = judged.where("NOT dropped").withColumn("stale", F.when(F.col("stale"), size).otherwise(0))
                rows = sum(t["key_count"] for t in used)
                parts = max(1, -(-rows // self.config.output_rows))
                cuts = L.grandchild_cuts(self._tables(), plan.next_level) if plan.next_level else []
                made = self._write_tables(kept, plan.next_level, parts, cuts)
            finally:
                judged.unpersist()
        with self._mutex:
            left = [t for t in self.state["tables"] if t["id"] not in ids]
            discard = Counter(self.state["discard"]) + Counter(freed)
            gone = self._retired([t["path"] for t in used])
            self._swap(tables=[*left, *made], next_id=self._next_id, discard=dict(discard), retired=gone)
        self.metrics["compaction_tables"] += len(used)
        self.metrics["bytes_compaction"] += sum(t["size"] for t in made)
        self.remove_retired()
        return made

    def write_amplification(self) -> float:
        """Bytes written to tables for each byte flushed, since the store was opened."""
        flushed = self.metrics["bytes_level0"]
        return (flushed + self.metrics["bytes_compaction"]) / flushed if flushed else 0.0

    def drop_prefix(self, prefix: bytes) -> None:
        """Removes all keys with ``prefix``, versions and all."""
        self.flush([prefix])
        self.compact(force=True, drop_prefixes=[prefix])

    def reclaim_values(self, share: float = 0.0) -> int:
        """Rewrites parts of the value log to the values still pointed to; how many values the log then has.

        A part is what one flush wrote.  It is rewritten if compactions have freed more
        than ``share`` of its bytes; pointers stay as they are, as files keep their ids.
        """
        self._writable()
        with self._mutex:
            freed = {int(k): n for k, n in self.state["discard"].items()}
            due = []
            for v in self.state["vlog"]:
                parts = v.split("#")
                low, high = (int(parts[2]), int(parts[3])) if len(parts) > 3 else (0, 1 << 62)
                bytes_ = sum(n for fid, n in freed.items() if low <= fid <= high)
                if bytes_ > share * self.files.size(parts[0]) or (len(parts) < 4 and freed):
                    due.append((v, low, high))
            for v, low, high in due:
                read = self._values([v])
                live = values.reclaim(read, self.records(resolve=False)).withColumn("len", F.octet_length("value"))
                entry, _ = self._write_values(live.sortWithinPartitions("fid", "offset"))
                discard = {k: n for k, n in self.state["discard"].items() if not low <= int(k) <= high}
                rest = [x for x in self.state["vlog"] if x != v]
                self._swap(vlog=[*rest, entry], discard=discard, retired=self._retired([v.split("#")[0]]), next_id=self._next_id)
            paths = [f"{self.files.root}/{v.split('#')[0]}" for v in self.state["vlog"]]
        self.remove_retired()
        return self.spark.read.schema("fid int").parquet(*paths).count() if paths else 0

    def check(self) -> list[str]:
        """What is wrong: overlaps within levels, files that are missing."""
        bad = [f"table {r.table_id} overlaps in level {r.level}" for r in tables.level_violations(self.table_info(), shared_key=True).collect()]
        return bad + [f"missing {t['path']}" for t in self.state["tables"] if not self.files.exists(t["path"])]

    # Changes and sizes

    def subscribe(self, subscriptions: Sequence[Subscription] | Registry, callback: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
        """Change events of commits; values are as written, before any separation."""
        if self.config.encryption_key:
            raise E.BadConfig("the log of an encrypted store can't be streamed")
        self.files.make("log")
        stream = self.spark.readStream.schema(S.KV).option("recursiveFileLookup", "true").parquet(f"{self.files.root}/log")
        return subscribe(stream, subscriptions, callback, checkpoint, once)

    def truncate_log(self) -> None:
        """Removes commits that are in tables; subscribers should have read them.

        Ingests that a transaction may still conflict with stay: those newer than the
        oldest open one, or than what callers who choose their versions have given up.
        """
        low = self.oracle.discard_ts()
        self.oracle.ingested = {ts: p for ts, p in self.oracle.ingested.items() if ts > low}
        kept = {c["path"] for c in self.state["log"]} | {*self.oracle.ingested.values()}
        for n in self.files.names("log"):
            if f"log/{n}" not in kept:
                self.files.delete(f"log/{n}")

    def sizes(self) -> dict[str, int]:
        return {"log": self.files.size("log"), "tables": self.files.size("sst"), "values": self.files.size("vlog")}

    def settings(self) -> dict:
        return asdict(replace(self.config, encryption_key=b""))
