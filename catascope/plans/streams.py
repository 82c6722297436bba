"""Queries that run the crawl log as a stream to the end of its input and read the sink.

Each has the SQL of its batch form: a stream that is told to take all available input must
end with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catascope.functions.snapshot import snapshot_of
from catascope.functions.urls import domain
from catascope.plans.catalogue import FLAG_SQL
from catascope.plans.registry import query
from catascope.plans.views import Catalogue
from catascope.session import scratch
from catascope.streaming import crawllog as cl


def stream(c: Catalogue) -> DataFrame:
    """The crawl log as a stream of events joined to the static pages."""
    events = c.table("events")
    pages = c.table("pages").select("page_id", "url")
    n = pages.count()
    log = c.spark.readStream.schema(events.schema).parquet(f"{c.dir}/event[s].parquet")
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "click"), 200).when(kind == "signup", 301).when(kind == "error", 404).otherwise(602)
    digest = F.when(kind.isin("view", "click"), F.md5(F.floor(F.col("value") / 50).cast("string")))
    return log.withColumn("pid", F.col("event_id") % n).join(pages, F.col("pid") == F.col("page_id")).select(
        F.col("url").alias("uri"),
        snapshot_of(F.col("ts")).alias("snapshot"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        status.alias("status"),
        digest.alias("digest"),
        domain(F.col("url")).alias("domain"),
        F.concat(domain(F.col("url")), F.lit("/"), F.col("event_id").cast("string")).alias("disklocation"),
        "event_id",
    )


@query("stream_ingest", "select snapshot, status, count(*) as results, count(distinct uri) as uris from v_crawllog group by all")
def stream_ingest(c: Catalogue):
    path = scratch(c.spark, "ingest")
    cl.ingest(stream(c), path).awaitTermination()
    rows = c.spark.read.parquet(path + "/data")
    return rows.groupBy("snapshot", "status").agg(F.count(F.lit(1)).alias("results"), F.countDistinct("uri").alias("uris"))


@query("stream_first_results", "select uri, snapshot, arg_min(event_id, (timestamp, event_id)) as event_id from v_crawllog group by all")
def stream_first_results(c: Catalogue):
    path = scratch(c.spark, "first")
    cl.first_results(stream(c), path).awaitTermination()
    return cl.firsts(c.spark, path).select("uri", "snapshot", "event_id")


@query("stream_status_counts", "select date_trunc('hour', timestamp) as window_start, domain, status, count(*) as count from v_crawllog group by all")
def stream_status_counts(c: Catalogue):
    path = scratch(c.spark, "status")
    cl.status_counts(stream(c), path).awaitTermination()
    return cl.counts(c.spark, path, ["window_start", "domain", "status"])


@query("stream_crawl_rate", """
with w as (select date_trunc('hour', timestamp) as window_start, count(*) as count from v_crawllog group by all)
select window_start, count, round(count / 3600, 9) as per_second, cast(sum(count) over (order by window_start) as bigint) as total,
  round(sum(count) over (order by window_start) / (epoch(window_start) - epoch(min(window_start) over ()) + 3600), 9) as per_second_since_start from w""")
def stream_crawl_rate(c: Catalogue):
    path = scratch(c.spark, "rate")
    cl.crawl_rate(stream(c), path).awaitTermination()
    rows = cl.rates_since_start(cl.rates(c.spark, path))
    return rows.withColumns({n: F.round(n, 9) for n in ("per_second", "per_second_since_start")})


@query("stream_content_changed", FLAG_SQL)
def stream_content_changed(c: Catalogue):
    path = scratch(c.spark, "changed")
    cl.changed_flags(stream(c), path).awaitTermination()
    return c.spark.read.parquet(path + "/data").select("uri", "snapshot", "timestamp", "event_id", "status", "digest", "contentchanged")
