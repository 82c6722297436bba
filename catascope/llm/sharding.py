"""Sharding by a two-pass external shuffle; every shard gets as many rows as the others."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from catascope.llm.common import bounded_batches, ship, stored

SHARDS = 16
SEED = 977
#: Bytes of text in a bucket: one is held in memory at a time.
BUCKET_BYTES = 8 << 20


def scattered(docs: DataFrame, size: Column, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """The first pass: documents with a bucket by seeded hash, and (bucket, base) of all buckets.

    base is the number of rows in the buckets before. Hashes of doc_id and text deal rows evenly,
    so the number of buckets follows from the bytes in total.
    """
    total = docs.agg(F.sum(size).alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    draw = F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])
    rows = docs.withColumns({"__draw": draw, "__bucket": F.pmod(draw, F.lit(buckets))})
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("__bucket") / 1024))
    # two levels: parts of 1024 buckets, then the buckets of a part
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    inside = counts.select("__bucket", "part", before(Window.partitionBy("part").orderBy("__bucket")).alias("within"))
    bases = inside.join(parts, "part").select("__bucket", (F.col("base") + F.col("within")).alias("base"))
    return rows, stored(bases, "buckets")


def permuted(seed: int, order: list[str]):
    """The second pass: one bucket, put into a fixed order, then through a seeded Fisher-Yates shuffle."""

    def run(key: tuple, rows: pa.Table, bases: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        rng = np.random.default_rng([seed, key[0].as_py()])
        rows = rows.take(pa.array(rng.permutation(rows.num_rows)))
        base = bases.column("base")[0].as_py()
        return rows.append_column("__position", pa.array(base + np.arange(rows.num_rows), pa.int64()))

    return run


def shuffled(docs: DataFrame, size: Column, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows with __position, their place in a random order of all rows."""
    bounded_batches(docs.sparkSession)
    rows, bases = scattered(docs, size, seed, bucket_bytes)
    schema = T.StructType([*rows.schema.fields, T.StructField("__position", T.LongType())])
    return (
        rows.groupBy("__bucket")
        .cogroup(bases.groupBy("__bucket"))
        .applyInArrow(permuted(seed, ["__draw", "doc_id", "__size"] if "__size" in docs.columns else ["__draw", "doc_id"]), schema)
    )


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns, with shard and slot; columns of these names are replaced.

    The law is `rows`: places in the random order are dealt to the shards in turn, so that counts
    differ by one at most, and slots of a shard run from 0 without gaps. Reruns agree: buckets and
    permutations follow from seed, doc_id and text; rows alike in both are interchangeable. Null
    texts and ids are rows like any other; an empty table gives no rows.
    """
    rows = shuffled(docs.drop("shard", "slot"), F.coalesce(F.octet_length("text"), F.lit(0)) + 1, seed, bucket_bytes)
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        (F.col("__position") % shards).cast("int").alias("shard"),
        F.floor(F.col("__position") / shards).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """A folder per shard, rows in the order of their slots."""
    rows = sharded(docs, shards).repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)


def assignment(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The contract's columns, without moving texts: their size, hash and checksum stand for them."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text"),
        (F.octet_length(text) + 1).cast("long").alias("__size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = shuffled(narrow, F.col("__size"))
    return rows.select(
        "doc_id",
        F.col("__size").alias("size"),
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("__position") % shards).cast("int").alias("shard"),
        F.floor(F.col("__position") / shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


ship(__name__)
