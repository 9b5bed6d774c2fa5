"""Sorted tables: statistics, overlap, ranges, listings, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselkv.operators.changefeed import DELETE, UPSERT, plain_op
from tesselkv.operators.merge import differences
from tesselkv.operators.ordered import running
from tesselkv.operators.skew import unique_join
from tesselkv.runtime import fresh, settled


def table_stats(kv: DataFrame, file: list[str]) -> DataFrame:
    """Per file: smallest and biggest key, records, greatest version, bytes."""
    size = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 12
    return kv.groupBy(*file).agg(
        F.min("user_key").alias("smallest"), F.max("user_key").alias("biggest"), F.count(F.lit(1)).alias("key_count"),
        F.max("version").alias("max_version"), F.sum(size.cast("bigint")).alias("uncompressed_size"),
    )


def listing(tables: DataFrame) -> DataFrame:
    """Tables as levels order them: level 0 by id (its age), others by smallest key."""
    return tables.orderBy("level", F.when(F.col("level") == 0, F.col("table_id")), F.when(F.col("level") > 0, F.col("smallest")), "table_id")


def level_violations(tables: DataFrame, shared_key: bool = False) -> DataFrame:
    """Tables of level 1 and deeper that begin before an earlier table of their level ends.

    The running maximum of ``biggest`` catches overlaps with any earlier table, not
    only with the one before; it runs over sorted partitions, not a task a level.
    With ``shared_key`` neighbours may meet in a key whose versions they divide.
    """
    deep = tables.where((F.col("level") >= 1) & F.col("smallest").isNotNull() & F.col("biggest").isNotNull())
    laid = running(deep, ["level"], ["smallest", "biggest", "table_id"], {"before": ("max", "biggest")})
    return laid.where(F.col("before") > F.col("smallest") if shared_key else F.col("before") >= F.col("smallest"))


def overlaps(left: str, right: str, other_left: str, other_right: str) -> Column:
    """Closed ranges share a key."""
    return (F.col(left) <= F.col(other_right)) & (F.col(other_left) <= F.col(right))


def range_union(tables: DataFrame, by: list[str]) -> DataFrame:
    """Per group the range of all its tables; unbounded once one is."""
    inf = F.max("inf") if "inf" in tables.columns else F.lit(False)
    return tables.groupBy(*by).agg(F.min("smallest").alias("left"), F.max("biggest").alias("right"), inf.alias("inf"))


def overlap_counts(tables: DataFrame, up: int = 1) -> DataFrame:
    """Per table the number and bytes of tables ``up`` levels deeper with a common key.

    Not a join of all pairs: along the sorted ends of the deeper level's tables,
    those that start at or before my end, less those that end before my start, are
    the ones that overlap; two running sums per level.  Ties: an end equal to a
    start is a common key.
    """
    ok = tables.where("smallest IS NOT NULL AND biggest IS NOT NULL AND level IS NOT NULL")
    size = F.coalesce("on_disk_size", F.lit(0)).cast("bigint")
    deep = ok.select((F.col("level") - up).alias("level"), "smallest", "biggest", size.alias("b"))
    zero = F.lit(0).cast("bigint")
    starts = deep.select("level", F.col("smallest").alias("at"), F.lit(0).alias("kind"), F.lit(1).cast("bigint").alias("n"), "b", F.lit(None).cast("int").alias("table_id"))
    ends = deep.select("level", F.col("biggest").alias("at"), F.lit(1).alias("kind"), F.lit(1).cast("bigint").alias("n"), "b", F.lit(None).cast("int").alias("table_id"))
    # starts <= my biggest: starts sort before me at equal keys; ends < my smallest: I sort before ends.
    mine_end = ok.select("level", F.col("biggest").alias("at"), F.lit(1).alias("kind"), zero.alias("n"), zero.alias("b"), "table_id")
    mine_start = ok.select("level", F.col("smallest").alias("at"), F.lit(0).alias("kind"), zero.alias("n"), zero.alias("b"), "table_id")

    def upto(a: DataFrame, b: DataFrame, sign: int) -> DataFrame:
        run = running(a.unionByName(b), ["level"], ["at", "kind"], {"cn": ("sum", "n"), "cb": ("sum", "b")})
        return run.where("table_id IS NOT NULL").select("level", "table_id", (F.col("cn") * sign).alias("n"), (F.col("cb") * sign).alias("b"))

    both = upto(starts, mine_end, 1).unionByName(upto(ends, mine_start, -1))
    return both.groupBy("level", "table_id").agg(F.sum("n").alias("n_overlaps"), F.sum("b").alias("overlap_bytes"))


def manifest_state(changes: DataFrame) -> DataFrame:
    """Tables after all changes with their level, key id and compression."""
    from tesselkv.operators.changefeed import apply_changes

    return apply_changes(None, changes, "table_id", "seq", "op", ["level", "key_id", "compression"])


def manifest_errors(changes: DataFrame) -> DataFrame:
    """Changes that contradict the state before them: deletes of unknown tables, creates of known ones.

    Copies of a change (equal ``seq``) count once.  A create at another level is a
    move and no error; at the same level it is a repeated create.
    """
    read = changes.withColumn("op", plain_op(F.col("op"))).where("op IS NOT NULL AND table_id IS NOT NULL AND seq IS NOT NULL")
    once = read.dropDuplicates(["table_id", "seq"])
    w = Window.partitionBy("table_id").orderBy("seq")
    told = once.withColumn("was", F.lag("op").over(w)).withColumn("was_level", F.lag("level").over(w))
    alive = F.coalesce(F.col("was") == UPSERT, F.lit(False))
    error = F.when((F.col("op") == DELETE) & ~alive, "unknown delete").when((F.col("op") == UPSERT) & alive & F.col("was_level").eqNullSafe(F.col("level")), "repeated create")
    return told.withColumn("error", error).where("error IS NOT NULL").select("table_id", "seq", "error")


def manifest_rewrite_due(changes: DataFrame) -> DataFrame:
    """One row: creations, deletions, and whether the manifest should be rewritten.

    Due above 10,000 deletions that are more than ten times the live tables.
    """
    read = changes.withColumn("op", plain_op(F.col("op"))).where("op IS NOT NULL").dropDuplicates(["table_id", "seq"])
    sums = read.agg(F.coalesce(F.sum((F.col("op") == UPSERT).cast("bigint")), F.lit(0)).alias("creations"), F.coalesce(F.sum((F.col("op") == DELETE).cast("bigint")), F.lit(0)).alias("deletions"))
    live = manifest_state(changes).count()
    return sums.withColumn("live", F.lit(live).cast("bigint")).withColumn("rewrite", (F.col("deletions") > 10_000) & (F.col("deletions") > 10 * F.col("live")))


def revert(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Files beside the manifest: 'extra' ones may be deleted, 'missing' ones are an error."""
    return differences(files, manifest_state(changes), "table_id")


def store_size(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Bytes and files by extension of a listing."""
    kind = F.regexp_extract(F.col(path), r"\.([a-z]+)$", 1)
    return files.groupBy(kind.alias("ext")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(length).alias("n_bytes"))


def prefix_overlap(keys: DataFrame, block: list[str], key: str = "user_key") -> DataFrame:
    """Keys with ``shared``: bytes in common with the first key of their block.

    Compared a byte at a time from the front, within the built-in functions: hex
    digits are compared by position and the first difference ends the prefix.  A block
    that holds a great part of the keys is spread.  Keys with a null block have none.
    """
    first, id_ = fresh(keys, "first", "block_id")
    rows = settled(keys.where(F.col(key).isNotNull()), "keys").withColumn(id_, F.struct(*[F.col(c) for c in block]))
    firsts = rows.groupBy(id_).agg(F.min(key).alias(first))
    both = unique_join(rows, firsts, id_, key).drop(id_)
    a, b = F.hex(F.col(first)), F.hex(F.col(key))
    short = F.least(F.octet_length(first), F.octet_length(key))
    places = F.when(short > 0, F.sequence(F.lit(1), short)).otherwise(F.array().cast("array<int>"))
    same = F.filter(places, lambda i: F.substring(a, i * 2 - 1, F.lit(2)) != F.substring(b, i * 2 - 1, F.lit(2)))
    return both.withColumn("shared", F.coalesce(F.array_min(same) - 1, short)).drop(first)
