"""Summaries of micro-batches in tiers: as many folders as the logarithm of the batches.

Folder level=k/at=j holds the merged summary of the batches j * FAN^k to (j + 1) * FAN^k - 1. When FAN
folders of a level are there, they are merged into one of the next level and removed, so every row
is written again once per level. A folder counts when its job has ended, and not if a folder of a
higher level covers it: whatever a failure leaves behind, each batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from catascope.sources import folders

FAN = 8


def _name(path: str, level: int, at: int) -> str:
    return f"{path}/level={level}/at={at}"


def live(spark: SparkSession, path: str, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, at) of the folders that count, the newest batches last."""
    found: list[tuple[int, int]] = []
    levels = sorted((int(n.split("=")[1]) for n in folders.names(spark, path)), reverse=True)
    for level in levels:
        for name in folders.names(spark, f"{path}/level={level}"):
            at = int(name.split("=")[1])
            if folders.complete(spark, _name(path, level, at)) and not _covered(found, level, at, fan):
                found.append((level, at))
    return sorted(found, key=lambda f: f[1] * fan ** f[0])


def _covered(found: list[tuple[int, int]], level: int, at: int, fan: int) -> bool:
    return any(at * fan**level // fan**k == j for k, j in found if k >= level)


def has(spark: SparkSession, path: str, number: int, fan: int = FAN) -> bool:
    """The batch is in a summary already."""
    return _covered(live(spark, path, fan), 0, number, fan)


def read(spark: SparkSession, path: str, schema: str | None = None, fan: int = FAN) -> DataFrame | None:
    """All summaries that count, not merged with each other; None before the first batch."""
    paths = [_name(path, *f) for f in live(spark, path, fan)]
    if not paths:
        return None
    return _union(spark, paths, schema)


def _union(spark: SparkSession, paths: list[str], schema: str | StructType | None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reduce(DataFrame.unionByName, [reader.parquet(p) for p in paths])  # each has partitions of its own


def _write(rows: DataFrame, path: str, by: tuple[str, ...]) -> None:
    # a folder is replaced as a whole; partition by partition it would get no mark of its end
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def add(
    path: str, number: int, rows: DataFrame, merge: Callable[[DataFrame], DataFrame], by: tuple[str, ...] = (), fan: int = FAN
) -> None:
    """Store the summary of a batch and merge what is full; a batch that is in already is left as it is.

    `by` names columns whose values are folders of their own, so that readers skip the others.
    """
    spark = rows.sparkSession
    if has(spark, path, number, fan):
        return
    _write(rows, _name(path, 0, number), by)
    level, at = 0, number
    while (at + 1) % fan == 0:
        parts = [_name(path, level, i) for i in range(at - fan + 1, at + 1)]
        if not all(folders.complete(spark, p) for p in parts):
            return
        merged = merge(_union(spark, parts, rows.schema))
        _write(merged.select(*rows.columns), _name(path, level + 1, at // fan), by)
        for p in parts:
            folders.remove(spark, p)
        level, at = level + 1, at // fan
