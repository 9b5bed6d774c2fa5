"""Large values apart from their records: separation, resolution, thresholds, reclaiming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselkv import schema as S
from tesselkv.functions.sketches import histogram_percentile, log_histogram
from tesselkv.operators.ordered import running, running_sum
from tesselkv.runtime import set_aside

POINTER_BYTES = 12
#: Fixed value: what 32 bits of an offset reach.
MOST_BYTES = (1 << 32) - 1


def separated(kv: DataFrame, threshold: int, file_size: int, order: list[str], max_entries: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, value log): values of ``threshold`` bytes and more go to the log.

    The log is laid out end to end in ``order`` and cut into files at ``file_size``
    bytes or, if given, ``max_entries`` entries: ``fid`` is the file a value starts in,
    ``offset`` its place there.  A record of a separated value keeps a pointer and the
    flag, and no value.  A file may run over its size by its last value, as the log
    turns over only between entries.
    """
    kv, undo = set_aside(kv, [*dict.fromkeys([*S.KV_COLUMNS, *order])])
    n = F.octet_length("value").cast("bigint")
    inline = kv.where(F.col("value").isNull() | (n < threshold))
    big = kv.where(n >= threshold).withColumn("n", n)
    if max_entries is None:
        big = running_sum(big, [], order, "n", "line")
        big = big.withColumn("fid", F.floor(F.col("line") / F.lit(file_size)).cast("int"))
        big = big.withColumn("at", F.pmod("line", F.lit(file_size)))
    else:  # after so many bytes or entries a file is full, whatever comes first
        big = running(big.withColumn("one", F.lit(1)), [], order, {"line": ("sum", "n"), "place": ("sum", "one")})
        big = big.withColumn("bytes_cut", F.floor(F.col("line") / F.lit(file_size))).withColumn("entries_cut", F.floor(F.col("place") / F.lit(max_entries)))
        big = big.withColumn("fid", (F.col("bytes_cut") + F.col("entries_cut")).cast("int"))
        # A file's values are at most those of one ``file_size``, so this window is bounded.
        big = big.withColumn("at", F.col("line") - F.min("line").over(Window.partitionBy("fid")))
    big = big.withColumn("vptr", F.struct("fid", F.col("n").cast("int").alias("len"), F.col("at").cast("int").alias("offset")))
    log = big.select(F.col("vptr.fid").alias("fid"), F.col("vptr.offset").alias("offset"), "value")
    flagged = F.col("meta").bitwiseOR(F.lit(S.VALUE_POINTER)).cast("smallint")
    moved = big.withColumn("meta", flagged).withColumn("value", F.lit(None).cast("binary")).select(*kv.columns)
    return undo(inline.unionByName(moved)), log


def resolved(kv: DataFrame, log: DataFrame) -> DataFrame:
    """``kv`` with separated values read back; a pointer to nothing leaves null."""
    at = log.select(F.col("fid").alias("_fid"), F.col("offset").alias("_offset"), F.col("value").alias("_value"))
    both = kv.join(at, (kv["vptr.fid"] == at["_fid"]) & (kv["vptr.offset"] == at["_offset"]), "left")
    return both.withColumn("value", F.coalesce("value", "_value")).drop("_fid", "_offset", "_value")


def dynamic_threshold(sizes: DataFrame, size: str, percentile: float, least: int, most: int) -> DataFrame:
    """One row: the value threshold at a share 0..1 of observed sizes; 0 means ``least``.

    The percentile comes from the log-bucket histogram and is kept within
    ``least`` and ``most``.
    """
    if not 0 <= percentile <= 1:
        raise ValueError("the percentile is a share from 0 to 1")
    spark = sizes.sparkSession
    if percentile == 0:
        return spark.range(1).select(F.lit(least).cast("bigint").alias("threshold"))
    p = histogram_percentile(log_histogram(sizes, size), [percentile * 100])
    return p.select(F.least(F.greatest(F.round("value").cast("bigint"), F.lit(least)), F.lit(most)).alias("threshold"))


def reclaim(log: DataFrame, kv: DataFrame) -> DataFrame:
    """The entries of ``log`` that a record still points to: what a rewrite keeps."""
    live = kv.where(S.has(S.VALUE_POINTER) & F.col("vptr").isNotNull()).select("vptr.fid", "vptr.offset").distinct()
    return log.join(live, ["fid", "offset"], "left_semi")


def write_validation(entries: DataFrame, file: str, order: list[str], n_bytes: str, limit: int = MOST_BYTES) -> DataFrame:
    """Entries that would end beyond ``limit`` of their file."""
    laid = running_sum(entries, [file], order, n_bytes, "start")
    return laid.withColumn("end", F.col("start") + F.coalesce(n_bytes, F.lit(0))).drop("start").where(F.col("end") > limit)
