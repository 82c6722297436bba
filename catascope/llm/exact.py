"""Exact dedup: a tree of merges over runs of digests. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import stored

#: Runs at the leaves, and how many of them one merge joins.
RUNS = 64
FAN_IN = 8

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SAME = ["digest", "n_bytes", "probe"]


def normalised(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id with SHA-256, length and a second hash of the normalised text."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    return norm.select(
        "doc_id",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("probe"),
    )


def merged_runs(rows: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per text: the largest doc_id and the number of documents.

    Every partition holds a run of digests. Runs meet in rounds of `fan_in`: run r goes to
    r / fan_in, and equal entries (digest, length and second hash all the same) become one with
    the largest id. A text in a third of all rows reaches a round as one entry per run.
    """
    level = rows.withColumn("run", F.spark_partition_id() % runs)
    level = level.groupBy("run", *SAME).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    while runs > 1:
        runs = -(-runs // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        level = level.groupBy("run", *SAME).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return level.drop("run")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 per row of documents.

    Texts are equal when they are identical after lower-casing A-Z; null is the empty text. The
    largest doc_id stays. Rows without doc_id count in group_size; they are kept only where no
    row of the group has an id (keep_id is then null). Rows that repeat the id that stays are
    the same document and all kept. An empty table gives an empty result; other columns are
    not read.
    """
    rows = stored(digests(docs), "digests")
    groups = stored(merged_runs(rows), "digest-groups")
    return rows.join(groups, SAME).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = """
with t as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
), g as (
  select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, text_sha256
  from t window w as (partition by text_sha256)
)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from g
"""
