"""Tables as Parquet: per-snapshot partitions, content stored once, repair, stored results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from catascope.operators.joins import portals_to_repair


def append(df: DataFrame, path: str, by: tuple[str, ...] = ("snapshot",)) -> None:
    """Append rows to a table partitioned by snapshot."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: tuple[str, ...] = ("snapshot",)) -> None:
    """Overwrite only the partitions the rows belong to; a repeated job ends in the same state."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table, or None where nothing has been written yet."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def new_content(records: DataFrame, stored: DataFrame | None) -> DataFrame:
    """One record per content hash that is not stored yet.

    Mapping and scoring run on these rows only. The choice is made on keys alone: copies
    collapse on the map side, known hashes drop out, and only then are the documents of the
    chosen records fetched.
    """
    key = ["snapshot", "portalid", "id"]
    first = records.where(F.col("md5").isNotNull()).groupBy("md5").agg(F.min(F.struct(*key)).alias("k"))
    if stored is not None:
        first = first.join(stored.select("md5"), "md5", "left_anti")
    return records.join(first.select("md5", "k.*"), ["md5", *key], "left_semi")


def without_partial(table: DataFrame, portals: DataFrame, runs: DataFrame, snapshot: int) -> DataFrame:
    """Aggregates without the rows of portals whose run in the snapshot has to be repeated."""
    broken = portals_to_repair(portals, runs, snapshot).withColumn("snapshot", F.lit(snapshot))
    return table.join(broken, ["portalid", "snapshot"], "left_anti")


def stored_or_computed(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """A stored result if there is one, else compute it, store it and read it back."""
    have = read(spark, path)
    if have is None:
        compute().write.mode("overwrite").parquet(path)
        have = spark.read.parquet(path)
    return have
