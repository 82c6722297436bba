"""The crawl log as a stream.

Results are Parquet folders written once per micro-batch under the batch's number, so a batch
that is repeated after a failure replaces its own output. Summaries and state lie in tiers that are
merged as they fill. Checkpoints lie beside the sinks in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catascope.operators.windows import content_changed
from catascope.streaming import tiers

LOG = (
    "uri string, snapshot int, timestamp timestamp, status int, digest string, domain string, "
    "disklocation string, event_id bigint"
)


def read_log(spark: SparkSession, path: str, schema: str = LOG, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _run(writer, path: str):
    return writer.option("checkpointLocation", path + "/_checkpoint").trigger(availableNow=True).start()


def ingest(log: DataFrame, path: str):
    """Append the log to a table partitioned by snapshot."""
    return _run(log.writeStream.format("parquet").partitionBy("snapshot").option("path", path + "/data").outputMode("append"), path)


def _summaries(log: DataFrame, path: str, summary: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]):
    """Keep the summary of every micro-batch, merged in tiers.

    A result counts however late it comes, no state is held between batches, and a repeated batch
    counts once.
    """
    def save(batch: DataFrame, number: int) -> None:
        tiers.add(path + "/data", number, summary(batch), merge)

    return _run(log.writeStream.foreachBatch(save), path)


def _earliest(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("uri", "snapshot")]
    first = F.min_by(F.struct(*rest), F.struct("timestamp", "event_id"))
    return rows.groupBy("uri", "snapshot").agg(first.alias("r")).select("uri", "snapshot", "r.*")


def first_results(log: DataFrame, path: str):
    """The first result per uri and snapshot of every micro-batch; read them with `firsts`."""
    return _summaries(log, path, _earliest, _earliest)


def firsts(spark: SparkSession, path: str) -> DataFrame:
    """One result per uri and snapshot, the earliest of all batches."""
    return _earliest(tiers.read(spark, path + "/data"))


def counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Counts per group over all batches."""
    return tiers.read(spark, path + "/data").groupBy(*keys).agg(F.sum("count").alias("count"))


def _added(rows: DataFrame) -> DataFrame:
    """Counts of several batches, added up."""
    return rows.groupBy(*[c for c in rows.columns if c != "count"]).agg(F.sum("count").alias("count"))


def status_windows(log: DataFrame, window: str = "1 hour") -> DataFrame:
    """Results per time window, domain and status."""
    grouped = log.groupBy(F.window("timestamp", window).alias("window"), "domain", "status")
    return grouped.agg(F.count(F.lit(1)).alias("count")).select(
        F.col("window.start").alias("window_start"), "domain", "status", "count"
    )


def status_counts(log: DataFrame, path: str, window: str = "1 hour"):
    return _summaries(log, path, lambda batch: status_windows(batch, window), _added)


def crawl_counts(log: DataFrame, window: str = "1 hour") -> DataFrame:
    """Results in every window."""
    grouped = log.groupBy(F.window("timestamp", window).alias("window")).agg(F.count(F.lit(1)).alias("count"))
    return grouped.select(F.col("window.start").alias("window_start"), "count")


def crawl_rate(log: DataFrame, path: str, window: str = "1 hour"):
    return _summaries(log, path, lambda batch: crawl_counts(batch, window), _added)


def rates(spark: SparkSession, path: str, seconds: int = 3600) -> DataFrame:
    """Results per second in every window, over all batches."""
    return counts(spark, path, ["window_start"]).withColumn("per_second", F.col("count") / seconds)


def rates_since_start(rates: DataFrame, seconds: int = 3600) -> DataFrame:
    """Rate since the first window beside the rate of each window; one row per window."""
    day = F.date_trunc("day", F.col("window_start"))
    days = rates.groupBy(day.alias("day")).agg(
        F.sum("count").alias("day_count"), F.min("window_start").alias("day_start")
    )
    order = W.orderBy("day")
    carried = days.select(
        "day",
        F.coalesce(F.sum("day_count").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.first("day_start").over(order).alias("start"),
    )
    inside = W.partitionBy("day").orderBy("window_start")
    rows = rates.withColumn("day", day).withColumn("so_far", F.sum("count").over(inside))
    rows = rows.join(carried, "day").withColumn("total", F.col("so_far") + F.col("before"))
    elapsed = F.unix_seconds(F.col("window_start")) - F.unix_seconds(F.col("start")) + seconds
    return rows.select(
        "window_start", "count", "per_second", "total", (F.col("total") / elapsed).alias("per_second_since_start")
    )


#: Folders that the last digests of all uris are dealt to.
BUCKETS = 64
STATE = "uri string, timestamp timestamp, event_id bigint, digest string, bucket int"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("uri"), F.lit(BUCKETS)).cast("int")


def _latest(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("timestamp", "event_id", "digest"), F.struct("timestamp", "event_id"))
    return rows.groupBy("uri", "bucket").agg(last.alias("r")).select("uri", "r.*", "bucket")


def changed_flags(log: DataFrame, path: str):
    """Content-changed flag of every result, against all results before it.

    Inside a micro-batch the flags come from the two-level window of the batch form. Only the
    first success of a uri needs what earlier batches saw: its last digest. Digests are dealt to
    buckets by uri; a batch reads the buckets of its own uris and adds what is new there, and tiers
    of batches are merged as they fill. No uri is bound to one task, a batch costs what it touches,
    and the state lives in the shared folder, not on an executor.
    """
    def flag(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if tiers.has(spark, path + "/state", number):
            return  # its results were written before its state
        rows = batch.withColumn("_new", F.lit(1))
        state = tiers.read(spark, path + "/state", STATE)
        if state is not None:
            uris = batch.select("uri", _bucket().alias("bucket")).distinct()
            touched = [r["bucket"] for r in uris.select("bucket").distinct().collect()]  # BUCKETS at most
            seeds = _latest(state.where(F.col("bucket").isin(touched)).join(uris, ["uri", "bucket"], "left_semi"))
            seeds = seeds.select(
                "uri", "timestamp", "digest", F.lit(200).alias("status"), F.lit(-1).cast("bigint").alias("event_id"), F.lit(0).alias("_new")
            )
            rows = rows.unionByName(seeds, allowMissingColumns=True)
        # what was seen before sorts before everything in the batch
        flagged = content_changed(rows, ("_new", "timestamp", "event_id"))
        done = flagged.where(F.col("_new") == 1).drop("_new", "last_digest")
        done.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        ok = batch.where(F.col("status") == 200).select("uri", "timestamp", "event_id", "digest", _bucket().alias("bucket"))
        tiers.add(path + "/state", number, _latest(ok), _latest, ("bucket",))

    return _run(log.writeStream.foreachBatch(flag), path)
