"""Tables laid out for reads of a few keys: files in the order of the key, and an index of what each file has."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_clustered(rows: DataFrame, path: str, keys: list[str], files: int) -> None:
    """Rows in about `files` files of equal size, sorted by the keys, with the least and greatest first
    key of each file beside them. A key with very many rows fills several files."""
    spark = rows.sparkSession
    rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.parquet(path + "/data")
    found = spark.read.parquet(path + "/data").groupBy(F.col("_metadata.file_path").alias("file"))
    found.agg(F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high"), F.count(F.lit(1)).alias("rows")).write.parquet(path + "/index")


def files_with(spark: SparkSession, path: str, value: str) -> list[str]:
    """The files that can have rows of a key."""
    index = spark.read.parquet(path + "/index").where((F.col("low") <= value) & (F.col("high") >= value))
    return sorted(unquote(r["file"]) for r in index.select("file").collect())


def read_key(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """The rows of a key; only files that can have some are opened, and in them only the blocks whose range has it."""
    files = files_with(spark, path, value)
    schema = spark.read.parquet(path + "/data").schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.where(F.col(key) == value)
