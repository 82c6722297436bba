"""Sequences over runs, lookups and crawl logs.

Windows run per portal or per dataset, where a snapshot occurs once: YYWW has at most 5,300
values, which bounds every such group. Crawl logs have no such bound; they are windowed in
two levels, see previous_value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catascope.functions.snapshot import next_snapshot, previous_snapshot
from catascope.functions.urls import domain
from catascope.session import staged


def run_sequence(runs: DataFrame) -> DataFrame:
    """Number of every finished run within its portal."""
    w = W.partitionBy("portalid").orderBy("snapshot")
    return runs.where(F.col("end_ts").isNotNull()).withColumn("run_no", F.row_number().over(w))


def harvest_progress(runs: DataFrame) -> DataFrame:
    """Share of portals finished by elapsed time since the first start of the snapshot."""
    first = W.partitionBy("snapshot")
    order = first.orderBy("elapsed", "portalid")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = runs.where(F.col("end_ts").isNotNull()).withColumn(
        "elapsed", (us("end_ts") - F.min(us("start_ts")).over(first)) / 1_000_000
    )
    n = F.count(F.lit(1)).over(first)
    x = F.when(n > 1, (F.row_number().over(order) - 1) / (n - 1)).otherwise(F.lit(0.0))
    return rows.select("snapshot", "portalid", "elapsed", x.alias("progress"))


def previous_runs(runs: DataFrame) -> DataFrame:
    """The snapshot before each run that the portal really has."""
    w = W.partitionBy("portalid").orderBy("snapshot")
    keys = runs.select("portalid", "snapshot").distinct()
    return keys.withColumn("previous", F.lag("snapshot").over(w))


def neighbour_weeks(runs: DataFrame) -> DataFrame:
    """Week before and after, where the portal was harvested in them."""
    w = W.partitionBy("portalid").orderBy("snapshot")
    sn = F.col("snapshot")
    back, ahead = F.lag("snapshot").over(w), F.lead("snapshot").over(w)
    return (
        runs.select("portalid", "snapshot").distinct()
        .withColumns({"back": back, "ahead": ahead})
        .select(
            "portalid",
            "snapshot",
            F.when(F.col("back") == previous_snapshot(sn), F.col("back")).alias("prev"),
            F.when(F.col("ahead") == next_snapshot(sn), F.col("ahead")).alias("next"),
        )
    )


def running_changes(dynamics: DataFrame) -> DataFrame:
    """Change ratios of all runs up to each run, oldest first (at most one per week)."""
    w = W.partitionBy("portalid").orderBy("snapshot").rowsBetween(W.unboundedPreceding, 0)
    return dynamics.select("portalid", "snapshot", F.collect_list("dyratio").over(w).alias("ratios"))


def last_digest(crawllog: DataFrame) -> DataFrame:
    """Digest of the latest successful download of every uri."""
    return crawllog.where(F.col("status") == 200).groupBy("uri").agg(
        F.max_by("digest", F.struct("timestamp", "event_id")).alias("digest"),
        F.max("timestamp").alias("timestamp"),
    )


def resource_history(history: DataFrame, source: str | None = None) -> DataFrame:
    """Observations of a resource in order of the snapshots."""
    rows = history if source is None else history.where(F.col("source") == source)
    return rows.orderBy("uri", "md5", "source", "snapshot")


def crawl_waves(seeds: DataFrame, seen: DataFrame | None = None, delay_seconds: int = 5) -> DataFrame:
    """Polite schedule: one uri per domain and wave, waves a delay apart, unseen uris only.

    Every uri of a domain needs its own number, so the numbers are dealt in two levels: a uri
    is numbered inside a hash bucket of its domain, and the buckets are laid one after the
    other. A domain that holds a third of all uris is spread over 1024 groups.
    """
    todo = seeds.select("uri").distinct()
    if seen is not None:
        todo = todo.join(seen.select("uri").distinct(), "uri", "left_anti")
    rows = todo.select("uri", domain(F.col("uri")).alias("domain"))
    numbered = dense_number(rows, ["domain"], "uri")
    return numbered.select(
        "domain", "uri", F.col("number").cast("bigint").alias("wave"),
        ((F.col("number") - 1) * delay_seconds).cast("bigint").alias("earliest_start"),
    )


def dense_number(rows: DataFrame, keys: list[str], unique: str, buckets: int = 1024) -> DataFrame:
    """Numbers 1..n within each key without bringing a key into one task.

    The order is by hash bucket (the first bits of the MD5), then by the unique column. The rows are
    stored once; numbers and sizes of buckets are read from there.
    """
    b = staged(rows.withColumn("_b", F.conv(F.substring(F.md5(unique), 1, 4), 16, 10).cast("int") % buckets), "numbered")
    sizes = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*keys, "_b").orderBy(unique)
    b = b.withColumn("_i", F.row_number().over(inside))
    return b.join(offsets, [*keys, "_b"]).withColumn("number", F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows range-partitioned along (keys, order) and stored, with the partition's number `_p`.

    Every partition has about as many rows as the others whatever the keys: a key with a third of
    all rows lies in a third of the partitions, whose numbers follow its order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(n, *keys, *order).withColumn("_p", F.spark_partition_id()), "ranged")


def previous_value(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Latest non-null value before each row of its key, exact and without a task per key.

    Inside a range partition a window looks back; what no row there knows comes from the last
    value of the key's partitions before, one row each.
    """
    inside = W.partitionBy(*keys, "_p").orderBy(*order)
    b = ranged(rows, keys, order).withColumns(
        {
            "_near": F.last(value, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1)),
            "_more": F.lead(F.lit(True)).over(inside),
        }
    )
    # the last row of a key in a partition knows the last value there: no second aggregation
    lasts = b.where(F.col("_more").isNull()).select(*keys, "_p", F.coalesce(value, "_near").alias("_last"))
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_p", F.last("_last", ignorenulls=True).over(before).alias("_far"))
    carried = carried.where(F.col("_far").isNotNull())
    out = b.join(carried, [*keys, "_p"], "left")
    return out.withColumn(name, F.coalesce("_near", "_far")).drop("_p", "_near", "_far", "_more")


def content_changed(crawllog: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """-1 without content, 0 same digest as the last success, 1 changed or first."""
    ok = F.col("status") == 200
    rows = crawllog.withColumn("_ok_digest", F.when(ok, F.col("digest")))
    rows = previous_value(rows, ["uri"], list(order), "_ok_digest", "last_digest")
    flag = F.when(~ok, -1).when(F.col("last_digest") == F.col("digest"), 0).otherwise(1)
    return rows.withColumn("contentchanged", flag.cast("int")).drop("_ok_digest")
