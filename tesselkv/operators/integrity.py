"""Checksums, encryption and compression of columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checksum(data: Column, algorithm: str = "crc32") -> Column:
    """CRC-32 or the engine's 64-bit hash of bytes, as a number."""
    if algorithm == "crc32":
        return F.crc32(data)
    if algorithm == "xxhash64":
        return F.xxhash64(data)
    raise ValueError("crc32 or xxhash64")


def with_checksum(df: DataFrame, data: str, out: str = "checksum", algorithm: str = "crc32") -> DataFrame:
    return df.withColumn(out, checksum(F.col(data), algorithm))


def corrupt(df: DataFrame, data: str, check: str = "checksum", algorithm: str = "crc32") -> DataFrame:
    """Rows whose bytes don't match; null matches null only (crc32)."""
    return df.where(~checksum(F.col(data), algorithm).eqNullSafe(F.col(check)))


def encrypted(data: Column, key: Column) -> Column:
    """AES-GCM with a fresh nonce, which travels with the bytes; keys of 16 or 32 bytes."""
    return F.aes_encrypt(data, key, F.lit("GCM"))


def decrypted(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM"))


CODECS = {0: "none", 1: "snappy", 2: "zstd"}


def codecs_of(spark: SparkSession, path: str) -> DataFrame:
    """Columns codec, n_files, n_chunks of the Parquet files in a folder, by their footers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["path"]:
                files, at = fs.FileSystem.from_uri(name)
                with files.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                rows += [(name, g.column(j).compression) for g in groups for j in range(g.num_columns)]
            yield pd.DataFrame(rows, columns=["path", "codec"])

    uri = F.regexp_replace("path", "^file:/+", "file:///")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(uri.alias("path"))
    each = found.mapInPandas(run, "path string, codec string")
    return each.groupBy("codec").agg(F.countDistinct("path").alias("n_files"), F.count(F.lit(1)).alias("n_chunks"))


def written_with(df: DataFrame, code: int, path: str, bloom_key: str | None = None) -> DataFrame:
    """Parquet with codec 0, 1 or 2 and, if asked, a Bloom filter on a key column."""
    writer = df.write.option("compression", CODECS[code])
    if bloom_key:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom_key}", "true")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
