"""Results of header lookups and downloads, landed as JSON, to their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope.functions.status import ROBOTS_DENIED, exception_code, transport_code
from catascope.functions.text import byte_size, mime_or_missing
from catascope.functions.urls import domain

LOOKUP = (
    "uri string, redirected_from string, snapshot int, timestamp timestamp, status int, "
    "exception string, message string, robots_denied boolean, header map<string,array<string>>"
)
DOWNLOAD = LOOKUP + ", crawltime_ms bigint, referrer string, disklocation string, content binary"


def read_lookups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOOKUP).json(path)


def lookup_rows(landed: DataFrame) -> DataFrame:
    """resourceinfo rows: a redirected lookup keeps the first url, a robots denial is 666."""
    denied = F.coalesce("robots_denied", F.lit(False))
    answered = ~denied & F.col("exception").isNull()
    header = F.transform_keys("header", lambda k, v: F.lower(k))
    first = lambda name: F.get(F.try_element_at(header, F.lit(name)), F.lit(0))
    size = F.coalesce(byte_size(first("content-length")), F.lit(0))
    return landed.select(
        F.coalesce("redirected_from", "uri").alias("uri"),
        "snapshot",
        "timestamp",
        F.when(denied, ROBOTS_DENIED)
        .when(F.col("exception").isNotNull(), exception_code(F.col("exception")))
        .otherwise(F.col("status"))
        .alias("status"),
        F.when(F.col("exception").isNotNull(), F.concat_ws(":", "exception", "message")).alias("exc"),
        F.when(answered, header).alias("header"),
        F.when(answered, mime_or_missing(first("content-type"))).alias("mime"),
        F.when(answered & (F.col("status") == 200), size).alias("size"),
    )


def newest_lookup(rows: DataFrame) -> DataFrame:
    """One row per uri and snapshot: the last answer."""
    rest = [c for c in rows.columns if c not in ("uri", "snapshot")]
    return rows.groupBy("uri", "snapshot").agg(F.max_by(F.struct(*rest), "timestamp").alias("r")).select("uri", "snapshot", "r.*")


def download_rows(landed: DataFrame) -> DataFrame:
    """Crawl log rows; digest, size and crawl time only for a successful download."""
    failed = F.col("exception").isNotNull()
    ok = ~failed & (F.col("status") == 200)
    first = lambda name: F.get(F.try_element_at(F.transform_keys("header", lambda k, v: F.lower(k)), F.lit(name)), F.lit(0))
    return landed.select(
        "uri",
        "snapshot",
        "timestamp",
        F.when(failed, transport_code(F.col("exception"))).otherwise(F.col("status")).alias("status"),
        F.col("exception").alias("exc"),
        "header",
        mime_or_missing(first("content-type")).alias("mime"),
        F.when(ok, F.octet_length("content").cast("bigint")).alias("size"),
        F.when(ok, F.col("crawltime_ms")).alias("crawltime"),
        "referrer",
        "disklocation",
        F.when(ok, F.md5("content")).alias("digest"),
        domain(F.col("uri")).alias("domain"),
    )
