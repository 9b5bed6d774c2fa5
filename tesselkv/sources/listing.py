"""Files of a folder as a table, without reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Columns path, name, ext, file_id, length, modified.

    ``file_id`` is the number a name consists of before its extension
    ('000012.sst'), null for other names.  Contents stay unread.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    number = F.regexp_extract(name, r"^([0-9]+)\.[a-z]+$", 1)
    return found.select("path", name.alias("name"), F.regexp_extract(name, r"\.([a-z]+)$", 1).alias("ext"), F.when(number != "", number.cast("bigint")).alias("file_id"), "length", F.col("modificationTime").alias("modified"))


def of_kind(listing: DataFrame, ext: str) -> DataFrame:
    """Files with an id and an extension, in order of id."""
    return listing.where((F.col("ext") == ext) & F.col("file_id").isNotNull()).orderBy("file_id")
