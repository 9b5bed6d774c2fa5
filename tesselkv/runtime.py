"""What the operators need from a session: tables, a shared folder, cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's checkpoint folder.

    That is ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was called with.  A
    folder of our own is made only where neither is set and the master is local
    (tests); on a cluster that would be another folder on each machine, and raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_dir:
        _own_dir[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tesselkv-")
    return _own_dir[context.applicationId]


def _path(spark: SparkSession, at: str):
    """(file system, path) of the JVM."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when the application ends at the latest."""
    at = f"{shared_dir(spark)}/tesselkv-{what}-{uuid.uuid4().hex}"
    files, path = _path(spark, at)
    files.deleteOnExit(path)
    return at


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage without depending on any executor's disk, and keeps a value
    that a recomputation could change (a partition number) fixed for all readers.
    Where the reader is done before the application is, ``release`` removes it.
    """
    spark = df.sparkSession
    at = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def release(df: DataFrame) -> int:
    """Removes the written tables that ``df`` reads, ``df`` not being needed any more; their number."""
    spark = df.sparkSession
    found = {m[1] for m in (re.match(r"(.*/tesselkv-[a-z]+-[0-9a-f]{32})/", f) for f in df.inputFiles()) if m}
    for at in found:
        files, path = _path(spark, at)
        files.delete(path, True)
    return len(found)


_PLAIN = re.compile(r"^[\s:+|-]*(Project|Filter|Relation|RelationV2|LocalRelation|LogicalRDD|Range|Union)\b")


def settled(df: DataFrame, what: str = "input") -> DataFrame:
    """``df`` itself if it is only a scan (with filters and columns), else ``written``.

    For operators that read their input more than once.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return df if all(_PLAIN.match(line) for line in plan.splitlines() if line.strip()) else written(df, what)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, work: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with only the columns ``work``, all others in one struct, and how to undo it.

    So an operator's working columns clash with none of the caller's.  Undoing puts
    the others back; where the operator has made a column of the same name, its own
    stays.
    """
    others = [c for c in df.columns if c not in work]
    if not others:
        return df, lambda done: done
    held = df.select(*work, F.struct(*[F.col(f"`{c}`") for c in others]).alias("_aside"))

    def undo(done: DataFrame) -> DataFrame:
        own = [c for c in done.columns if c != "_aside"]
        return done.select(*own, *[F.col(f"_aside.`{c}`").alias(c) for c in others if c not in own])

    return held, undo
