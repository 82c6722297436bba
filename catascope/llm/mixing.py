"""Mixing sources to target weights by blocks of words dealt to output shards by a splitting tree."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import running_start, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SHARDS = 16
BLOCK_WORDS = 4096
SEED = 20240601
#: The random generator splits at most 10^9 blocks; blocks grow beyond that.
MOST_BLOCKS = 500_000_000

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words per source: `share` of all words by weight, at most `cap` times a source's own words.

    What is above a source's limit is shared again by weight among the others. Sources whose limit
    is low for their weight reach it first, so they are settled in that order.
    """
    left, weight, out = share * sum(sizes), float(sum(weights)), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i]):
        out[i] = min(cap * float(sizes[i]), left * weights[i] / weight if weight else 0.0)
        left, weight = left - out[i], weight - weights[i]
    return out


def quotas(blocks: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source per shard (shards x sources).

    Every node of the tree parts its blocks between two halves of its shards: the left half gets
    its exact number of blocks, and how many of each source is one multivariate hypergeometric draw.
    """
    out = np.zeros((shards, len(blocks)), dtype=np.int64)
    rng = np.random.default_rng(seed)

    def split(own: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = own
            return
        middle = (low + high) // 2
        left = rng.multivariate_hypergeometric(own, int(own.sum()) * (middle - low) // (high - low), method="marginals")
        split(left, low, middle)
        split(own - left, middle, high)

    split(np.asarray(blocks, dtype=np.int64), 0, shards)
    return out


def stride(n: int, rng: np.random.Generator) -> int:
    """A step that visits all of n blocks; below 2^20, so that block times step fits into a long."""
    while True:
        step = int(rng.integers(1, 1 << 20))
        if math.gcd(step, max(n, 1)) == 1:
            return step


def keyed(docs: DataFrame, seed: int) -> tuple[Column, Column]:
    """Size, and the seeded hash that puts the documents of a source into random order."""
    return words(docs["text"]), F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])


def plan(sizes: DataFrame, shards: int = SHARDS, weights: tuple = WEIGHTS, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: sizes, target, words to take, block permutation, and shard limits.

    `sizes` is (source, size). Sources are names of collections; their list, one short row each,
    is the only thing that the driver sees.
    """
    spark = sizes.sparkSession
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    own = [r["n"] for r in rows]
    target = targets(own, [weights[i % len(weights)] for i in range(len(rows))])
    take = [min(CAP * n, round(t)) for n, t in zip(own, target)]
    block = max(block_words, -(-sum(take) // MOST_BLOCKS))
    blocks = np.array([-(-t // block) for t in take], dtype=np.int64)
    limits = quotas(blocks, shards, seed).cumsum(0).T.tolist() if rows else []
    rng = np.random.default_rng(seed + 1)
    data = [
        (r["source"], n, t, k, block, int(b), stride(int(b), rng), int(rng.integers(0, max(int(b), 1))), ends)
        for r, n, t, k, b, ends in zip(rows, own, target, take, blocks, limits)
    ]
    return spark.createDataFrame(
        data,
        "source string, source_size long, target double, take long, block_words long, n_blocks long, step long, shift long, limits array<long>",
    )


def pieces() -> Column:
    """The blocks that take words of a document: pass over the source, block, shard, words.

    Passes over a source follow each other in one stream of words, which is cut into blocks; the
    words to take are the front of the stream. Documents stand there in random order, and blocks
    are permuted again before their source's quotas deal them to shards.
    """
    end = lambda p: F.least(F.col("take"), p * F.col("source_size") + F.col("start") + F.col("size"))

    def in_pass(p: Column) -> Column:
        low, high = p * F.col("source_size") + F.col("start"), end(p)
        first, last = F.floor(low / F.col("block_words")), F.floor((high - 1) / F.col("block_words"))

        def piece(b: Column) -> Column:
            rank = F.pmod(b * F.col("step") + F.col("shift"), F.col("n_blocks"))
            cut = F.least(high, (b + 1) * F.col("block_words")) - F.greatest(low, b * F.col("block_words"))
            return F.struct(
                p.alias("pass"),
                b.alias("block"),
                F.size(F.filter("limits", lambda x: x <= rank)).alias("shard"),
                cut.alias("words"),
            )

        return F.when(high > low, F.transform(F.sequence(first, last), piece)).otherwise(F.array().cast("array<struct<pass:int,block:bigint,shard:int,words:bigint>>"))

    return F.flatten(F.transform(F.array(*[F.lit(p) for p in range(CAP)]), in_pass))


def mixed(docs: DataFrame, shards: int = SHARDS, weights: tuple = WEIGHTS, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, start, pieces, taken per row of documents.

    Null texts have size 0, and documents of size 0 are never taken. Null is a source of its own,
    the last one. Rows that are alike in all columns share a place in the order; which of them is
    cut at the end of the target is then left open. A source with no words has target 0; an empty
    table gives no rows; other columns are not read.
    """
    size, key = keyed(docs, seed)
    rows = stored(docs.select("doc_id", "source", size.alias("size"), key.alias("key")), "mix-sizes")
    sources = plan(rows.select("source", "size"), shards, weights, seed, block_words)
    placed = running_start(rows, ["source"], ["key", "doc_id", "size"], "size", "start", F.shiftright("key", 52))
    sources = sources.withColumnRenamed("source", "__source")
    placed = placed.join(sources, placed["source"].eqNullSafe(sources["__source"]))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return placed.withColumn("pieces", pieces()).withColumn("taken", taken)


def copies(seed: int) -> Column:
    """Of each pass that takes words of a document: pass, the shard of its first block, and a random order there."""

    def of_pass(p: Column) -> Column:
        own = F.filter("pieces", lambda x: x["pass"] == p)
        order = F.xxhash64(F.lit(seed + 2), "key", "doc_id", p)
        return F.when(F.size(own) > 0, F.struct(p.alias("pass"), F.get(own, F.lit(0))["shard"].alias("shard"), order.alias("order")))

    return F.array_compact(F.transform(F.array(*[F.lit(p) for p in range(CAP)]), of_pass))


def dealt(placed: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows of `mixed` with shard and place: where the document's first copy lies in the shuffled shards.

    A shard is shuffled by a seeded hash. Places are counted from 0 per shard over all first copies,
    in buckets of the hash; documents that are not taken have neither.
    """
    first = F.get(copies(seed), F.lit(0))
    rows = stored(placed.withColumns({"shard": first["shard"], "order": first["order"]}).drop("pieces"), "mix-copies")
    some = rows.where("shard is not null").withColumn("one", F.lit(1))
    some = running_start(some, ["shard"], ["order", "doc_id", "size"], "one", "place", F.shiftright("order", 52))
    return some.drop("one").unionByName(rows.where("shard is null").withColumn("place", F.lit(None).cast("long")))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Whole documents in the mixture's proportions, repeated ones as repeated rows; same columns.

    A document is taken in a pass if half of its words lie before the end of the target. Its copies go
    to the shards that the splitting tree deals their blocks to, and rows of a shard follow its seeded
    order within their partition; texts move once to meet their copies and once to their shards.
    Null texts have no words and go, as do empty ones; null is a source and null ids are rows like
    others. Rows that repeat source, id and text are all taken where one is. Empty tables stay empty.
    """
    size, key = keyed(docs, seed)
    placed = mixed(docs, weights=weights, seed=seed)
    middle = lambda p: p * F.col("source_size") + F.col("start") + F.col("size") / 2 <= F.col("take")
    taken = F.filter(copies(seed), lambda c: middle(c["pass"]))
    mine = ["__source", "__none", "__id", "__key"]
    named = {"__source": F.concat(F.lit("="), "source"), "__none": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0))}
    named["__source"] = F.coalesce(named["__source"], F.lit("-"))
    rows = placed.where("size > 0").withColumns(named | {"__key": F.col("key"), "__copies": taken}).where("size(__copies) > 0")
    # rows alike lie side by side in the order and go where the first of them goes
    each = rows.select(*mine, F.explode("__copies").alias("c")).groupBy(*mine, "c.pass").agg(F.min(F.struct("c.shard", "c.order")).alias("at"))
    each = stored(each.groupBy(*mine).agg(F.collect_list("at").alias("__copies")), "mix-copies")
    rows = docs.withColumns(named | {"__key": key}).join(each.hint("shuffle_merge"), mine)
    rows = rows.withColumn("__copy", F.explode("__copies")).withColumns({"__shard": F.col("__copy.shard"), "__order": F.col("__copy.order")})
    rows = rows.repartition("__shard", F.shiftright("__order", 54)).sortWithinPartitions("__shard", "__order")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
