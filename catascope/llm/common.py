"""Helpers that several operators share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catascope.session import scratch

ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def ship(module: str) -> None:
    """Send the functions of a module to Python workers by value, so that these need no import path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches that stay small when texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there, and executors may be lost.

    Joins see the size of the written files, so that Spark broadcasts by it, and a join whose
    sides both come from files can split a hot key.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """SHA-256 of a whole text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running_start(
    rows: DataFrame, group: list[str], order: list[str], amount: str, out: str, bucket: Column
) -> DataFrame:
    """The sum of `amount` over the rows before each one, per group, in two levels.

    `bucket` must not decrease along the order within a group. Sums per bucket are added up
    first; then each bucket is summed by itself, so a hot group is spread over its buckets.
    """
    rows = rows.withColumn("__bucket", bucket)
    sums = rows.groupBy(*group, "__bucket").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = (
        Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = rows.withColumn("__before", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = F.lit(True)
    for c in (*group, "__bucket"):
        same = same & local[c].eqNullSafe(sums[c])
    joined = local.join(sums, same, "left")
    return joined.select(*[local[c] for c in rows.columns if c != "__bucket"], (F.col("__base") + F.col("__before")).alias(out))
