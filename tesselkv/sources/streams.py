"""Tables of a data directory as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselkv.runtime import table


def stream_table(spark: SparkSession, d: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A table as a stream: its files in turn, whether it is one file or a folder."""
    at = f"{d}/{name}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(table(spark, d, name).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d) if whole else reader.parquet(at)
