"""Many small files into few well-sized ones, byte by byte.

Two halves.  ``plan_merges`` lays small tables end to end per level and cuts the
line into outputs, so every table has one output, one place in it and one byte
range.  ``concatenate`` carries such a layout out on real files: it copies bytes
without parsing records, and checks lengths and checksums of what it wrote.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselkv.operators.ordered import running_sum

SMALL_BYTES = 524_288
TARGET_BYTES = 8 * 1024 * 1024
CHUNK = 1 << 20


def latest_listing(listings: DataFrame) -> DataFrame:
    """One row per table: what its latest listing says, and the latest known size.

    ``level`` and the key columns come from the latest listing of all, ``n_bytes``
    from the latest one with a positive ``on_disk_size`` (null if there is none).
    A later ``listed_at`` wins, then the greater ``listing_id``; a null time is the
    oldest.  Rows without a ``table_id`` are left out.  Aggregates combine before
    the shuffle, so a table listed very often is no large task.
    """
    when = (F.col("listed_at"), F.coalesce(F.col("listing_id"), F.lit(-1)))
    whole = F.struct(*[x.alias(f"w{i}") for i, x in enumerate(when)], "level", "smallest", "key_count")
    sized = F.when(F.col("on_disk_size") > 0, F.struct(*[x.alias(f"w{i}") for i, x in enumerate(when)], "on_disk_size"))
    last = listings.where(F.col("table_id").isNotNull()).groupBy("table_id").agg(F.max(whole).alias("w"), F.max(sized).alias("s"))
    return last.select("table_id", "w.level", "w.smallest", F.coalesce("w.key_count", F.lit(0)).alias("key_count"), F.col("s.on_disk_size").alias("n_bytes"))


def plan_merges(listings: DataFrame, small: int = SMALL_BYTES, target: int = TARGET_BYTES) -> DataFrame:
    """The tables to merge, each once, with its output and its byte range there.

    A table takes part when its latest known size is below ``small``.  Per level,
    tables lie end to end in key order; a table belongs to the output in whose
    ``target`` bytes it starts, so outputs are at most ``target + small`` long, and
    all but the last of a level at least ``target - small``.  Key order keeps the
    outputs of a level free of overlap where its tables are.  A table of unknown
    size is left alone.  Columns: level, output, table_id, key_count, n_bytes,
    line_start (place in the level's line; an output's bytes are contiguous there).
    """
    few = latest_listing(listings).where(F.col("n_bytes") < small)
    laid = running_sum(few, ["level"], ["smallest", "table_id"], "n_bytes", "line_start")
    output = F.floor(F.col("line_start") / F.lit(target)).cast("bigint")
    return laid.select("level", output.alias("output"), "table_id", "key_count", "n_bytes", "line_start")


def merge_outputs(plan: DataFrame) -> DataFrame:
    """Per output of a plan: tables, keys and bytes; no byte of the line is lost."""
    outputs = plan.groupBy("level", "output").agg(
        F.count(F.lit(1)).alias("n_tables"), F.sum("key_count").alias("key_count"), F.sum("n_bytes").alias("n_bytes"),
        (F.max(F.col("line_start") + F.col("n_bytes")) - F.min("line_start")).alias("line_bytes"),
    )
    return outputs.select("level", "output", "n_tables", "key_count", "n_bytes", (F.col("n_bytes") == F.col("line_bytes")).alias("contiguous"))


class BadInput(ValueError):
    """An input file that may not be joined to others as it is."""


class _Bytes:
    """A file as a sequence of bytes of which only a piece is in memory."""

    def __init__(self, file):
        self.file, self.n, self.at, self.held = file, file.size(), 0, b""

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, span: slice) -> bytes:
        start, end = span.start, min(span.stop, self.n)
        if not self.at <= start <= end <= self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(CHUNK, end - start))
        return self.held[start - self.at : end - self.at]


def frame_ends(data: bytes | _Bytes) -> list[int]:
    """Where each zstandard frame of ``data`` ends, by the public format (RFC 8878).

    Only headers are read: no block is decompressed.  Raises ``BadInput`` unless
    the bytes are whole frames, skippable ones included.
    """
    at, ends, n = 0, [], len(data)

    def number(start: int, size: int) -> int:
        if start + size > n:
            raise BadInput("zstandard frame is cut off")
        return int.from_bytes(data[start : start + size], "little")

    while at < n:
        magic = number(at, 4)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + number(at + 4, 4)
        elif magic == 0xFD2FB528:
            descriptor = number(at + 4, 1)
            single = descriptor >> 5 & 1
            content = (1 if single else 0, 2, 4, 8)[descriptor >> 6]
            dictionary = (0, 1, 2, 4)[descriptor & 3]
            at += 5 + (1 - single) + dictionary + content
            last = False
            while not last:
                block = number(at, 3)
                last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
                if kind == 3:
                    raise BadInput("zstandard block of a reserved kind")
                at += 3 + (1 if kind == 1 else size)
            at += 4 * (descriptor >> 2 & 1)
        else:
            raise BadInput("no zstandard frame starts here")
        if at > n:
            raise BadInput("zstandard frame is cut off")
        ends.append(at)
    return ends


class _Output:
    """One output in the making, under a name that no other attempt of its task has."""

    def __init__(self, out: str, kind: str, with_header: bool):
        self.out, self.kind, self.with_header = out, kind, with_header
        self.files, self.target = fs.FileSystem.from_uri(out)
        folder, _, name = self.target.rpartition("/")
        self.hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.files.create_dir(folder, recursive=True)
        self.sink = self.files.open_output_stream(self.hidden)
        self.crc = self.length = self.read = self.lines = self.inputs = 0
        self.header: bytes | None = None

    def put(self, piece: bytes) -> None:
        self.sink.write(piece)
        self.crc, self.length = zlib.crc32(piece, self.crc), self.length + len(piece)

    def add(self, path: str, expected: int | None) -> None:
        source, at = fs.FileSystem.from_uri(path)
        with source.open_input_file(at) as f:
            size = f.size()
            if expected is not None and size != expected:
                raise BadInput(f"{path} has {size} bytes, and {expected} were planned")
            self.read, self.inputs = self.read + size, self.inputs + 1
            if self.kind == "zstd":
                frame_ends(_Bytes(f))
                f.seek(0)
                while chunk := f.read(CHUNK):
                    self.put(chunk)
                return
            if f.read(3) != b"\xef\xbb\xbf":
                f.seek(0)
            if self.with_header and size:
                self._header(f)
            last = b"\n"
            while chunk := f.read(CHUNK):
                self.put(chunk)
                self.lines, last = self.lines + chunk.count(b"\n"), chunk[-1:]
            if last != b"\n":
                self.put(b"\n")
                self.lines += 1

    def _header(self, f) -> None:
        """Passes the first line over; the first file's goes to the output."""
        start, line = f.tell(), b""
        while b"\n" not in line and (chunk := f.read(CHUNK)):
            line += chunk
        line, newline, _ = line.partition(b"\n")
        if self.header is None:
            self.header = line
            self.put(line + b"\n")
        elif line != self.header:
            raise BadInput("header differs from the first file's")
        f.seek(start + len(line) + len(newline))

    def drop(self) -> None:
        self.sink.close()
        self.files.delete_file(self.hidden)

    def close(self) -> dict:
        """The output appears, if what was written reads back with its length and checksum."""
        self.sink.close()
        check = size = 0
        with self.files.open_input_stream(self.hidden) as f:
            while chunk := f.read(CHUNK):
                check, size = zlib.crc32(chunk, check), size + len(chunk)
        if (check, size) != (self.crc, self.length):
            self.files.delete_file(self.hidden)
            raise OSError(f"{self.out}: wrote {self.length} bytes, read back {size}, or their checksum differs")
        self.files.move(self.hidden, self.target)
        return {"out": self.out, "n_inputs": self.inputs, "bytes_in": self.read, "bytes_out": self.length, "n_lines": self.lines, "crc32": self.crc}


_REPORT = "out string, n_inputs long, bytes_in long, bytes_out long, n_lines long, crc32 long"


def concatenate(layout: DataFrame, kind: str = "lines", with_header: bool = False) -> DataFrame:
    """Write the outputs of ``layout`` (columns out, place, path: URIs) and report them.

    ``kind`` is 'lines' (newline-delimited; a missing last newline is added, a byte
    order mark and, ``with_header``, the repeated first line are dropped) or 'zstd'
    (whole frames, which stay frames).  Empty inputs add nothing.  A column ``n_bytes``
    is the length each input must have.  An input that is cut off, or whose header or
    length differs, fails the job before its output appears: an output is written
    under a name of its attempt, read back against length and CRC-32, then renamed, so
    tasks that run twice, even at the same time, leave the same file.  One task writes
    one output, in pieces of a megabyte, its inputs in turn; nothing is collected.
    ``n_lines`` counts the records of 'lines', without headers.  Rows with a null path
    or output are left out; a repeated row repeats its file.
    """
    if kind not in ("lines", "zstd") or (kind == "zstd" and with_header):
        raise ValueError("kind is 'lines' (with or without header) or 'zstd'")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, done = None, []
        try:
            for batch in batches:
                for out, path, n in zip(batch["out"], batch["path"], batch["n_bytes"], strict=True):
                    if now is None or now.out != out:
                        if now is not None:
                            done.append(now.close())
                        now = None
                        now = _Output(out, kind, with_header)
                    now.add(path, None if pd.isna(n) else int(n))
                yield pd.DataFrame(done, columns=[c.split()[0] for c in _REPORT.split(", ")])
                done = []
            if now is not None:
                last, now = now, None
                yield pd.DataFrame([last.close()])
        finally:
            if now is not None:
                now.drop()

    n = F.col("n_bytes").cast("bigint") if "n_bytes" in layout.columns else F.lit(None).cast("bigint").alias("n_bytes")
    rows = layout.where(F.col("path").isNotNull() & F.col("out").isNotNull()).select("out", "place", "path", n)
    return rows.repartition("out").sortWithinPartitions("out", "place", "path").mapInPandas(run, _REPORT)


def file_layout(plan: DataFrame, files: DataFrame, folder: str, suffix: str = "") -> DataFrame:
    """What ``concatenate`` needs to carry out ``plan_merges``: columns out, place, path, n_bytes.

    ``files`` (table_id, path, n_bytes) has one row per table.  Outputs of a single
    input are left out: that file stays as it is.  A planned table without a file
    raises when the layout is used.
    """
    several = plan.groupBy("level", "output").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    plan = plan.select("level", "output", "table_id", "line_start")
    same = plan["level"].eqNullSafe(several["level"]) & (plan["output"] == several["output"])
    rows = plan.join(several, same, "left_semi").join(files.select("table_id", "path", "n_bytes"), "table_id", "left")
    level = F.coalesce(F.col("level").cast("string"), F.lit("none"))
    out = F.concat(F.lit(f"{folder.rstrip('/')}/"), level, F.lit("/"), F.col("output").cast("string"), F.lit(suffix))
    path = F.when(F.col("path").isNull(), F.raise_error(F.concat(F.lit("no file of table "), F.col("table_id").cast("string")))).otherwise(F.col("path"))
    return rows.select(out.alias("out"), F.col("line_start").alias("place"), path.alias("path"), "n_bytes")


def retire(layout: DataFrame, report: DataFrame) -> DataFrame:
    """Deletes the inputs of outputs that are whole, and says how many of each: columns out, n_deleted.

    Whole means that the output has all inputs of its layout and their bytes, and is
    there with the reported length; the inputs of any other output stay.
    """
    planned = layout.where(F.col("path").isNotNull() & F.col("out").isNotNull())
    sums = planned.groupBy("out").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"))
    whole = report.join(sums, "out").where((F.col("n") == F.col("n_inputs")) & (F.coalesce("b", "bytes_in") == F.col("bytes_in")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths: dict[str, int] = {}
        for batch in batches:
            gone = []
            for out, path, length in zip(batch["out"], batch["path"], batch["bytes_out"], strict=True):
                if out not in lengths:
                    lengths = {out: fs.FileSystem.from_uri(out)[0].get_file_info(fs.FileSystem.from_uri(out)[1]).size or 0}
                files, at = fs.FileSystem.from_uri(path)
                there = lengths[out] == length and files.get_file_info(at).type == fs.FileType.File
                if there:
                    files.delete_file(at)
                gone.append(int(there))
            yield pd.DataFrame({"out": batch["out"], "n": gone})

    rows = planned.select("out", "path").distinct().join(whole.select("out", "bytes_out"), "out")
    return rows.sortWithinPartitions("out").mapInPandas(run, "out string, n long").groupBy("out").agg(F.sum("n").alias("n_deleted"))


def write_lines(df: DataFrame, path: str, line: str, order: Sequence[str]) -> DataFrame:
    """Writes a newline-delimited file for each ``path`` (URIs), its ``line`` values in ``order``; columns path, n_bytes.

    A file's lines are streamed by one task, not collected.  Rows without a path are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sink, n, done = None, None, 0, []
        for batch in batches:
            for to, text in zip(batch["_to"], batch["_line"], strict=True):
                if to != at:
                    if at is not None:
                        done.append((at, n, sink.close()))
                    files, name = fs.FileSystem.from_uri(to)
                    at, n, sink = to, 0, files.open_output_stream(name)
                data = ("" if text is None else text).encode() + b"\n"
                sink.write(data)
                n += len(data)
            yield pd.DataFrame([x[:2] for x in done], columns=["path", "n_bytes"])
            done = []
        if at is not None:
            sink.close()
            yield pd.DataFrame([(at, n)], columns=["path", "n_bytes"])

    rows = df.where(F.col(path).isNotNull()).select(F.col(path).alias("_to"), F.col(line).alias("_line"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    by = ["_to", *[f"_o{i}" for i in range(len(order))]]
    return rows.repartition("_to").sortWithinPartitions(*by).select("_to", "_line").mapInPandas(run, "path string, n_bytes long")
