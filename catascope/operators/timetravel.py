"""Questions as of a date or snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catascope.session import staged


def as_of(datasets: DataFrame, snapshot: int, keys=("portalid", "id")) -> DataFrame:
    """The newest row of each key that is not newer than the snapshot."""
    rest = [c for c in datasets.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.col("snapshot")).alias("_row")
    return datasets.where(F.col("snapshot") <= snapshot).groupBy(*keys).agg(row).select(*keys, "_row.*")


def as_of_join(requests: DataFrame, versions: DataFrame, keys=("portalid", "id"), values=("md5",)) -> DataFrame:
    """For every request (keys, snapshot) the newest version not newer than it.

    Distinct requests and versions are laid into one sequence per key, so nothing is compared
    pairwise; a key has at most one of each per week. The answers then go back to the requests
    by equality, where a much requested dataset is split by the skew join.
    """
    keys = list(keys)
    version = F.struct(F.col("snapshot").alias("found"), *[F.col(v) for v in values])
    have = versions.select(*keys, "snapshot", version.alias("v"), F.lit(0).alias("asks"))
    asked = requests.select(*keys, "snapshot").distinct()
    want = asked.withColumn("v", F.lit(None).cast(have.schema["v"].dataType)).withColumn("asks", F.lit(1))
    w = W.partitionBy(*keys).orderBy("snapshot", "asks").rowsBetween(W.unboundedPreceding, 0)
    line = have.unionByName(want).withColumn("v", F.last("v", ignorenulls=True).over(w))
    answers = line.where((F.col("asks") == 1) & F.col("v").isNotNull()).select(*keys, "snapshot", "v.*")
    return requests.join(answers, [*keys, "snapshot"])


def latest_download(crawllog: DataFrame, uri: str | None = None) -> DataFrame:
    rows = crawllog if uri is None else crawllog.where(F.col("uri") == uri)
    order = F.struct("timestamp", "event_id")
    return rows.groupBy("uri").agg(
        F.max_by("disklocation", order).alias("disklocation"), F.max("timestamp").alias("timestamp")
    )


def first_after(crawllog: DataFrame, when, uri: str | None = None) -> DataFrame:
    """First download of a uri after a date."""
    rows = crawllog.where(F.col("timestamp") > when)
    rows = rows if uri is None else rows.where(F.col("uri") == uri)
    return rows.groupBy("uri").agg(
        F.min_by("disklocation", F.struct("timestamp", "event_id")).alias("disklocation"),
        F.min("timestamp").alias("timestamp"),
    )


def time_map(flagged: DataFrame, uri: str | None = None, without_content: bool = False) -> DataFrame:
    """Versions with changed content, each with the first and last version of its uri."""
    wanted = (-1, 1) if without_content else (1,)
    rows = flagged.where(F.col("contentchanged").isin(*wanted))
    rows = rows if uri is None else rows.where(F.col("uri") == uri)
    rows = staged(rows.select("uri", "timestamp", "event_id"), "versions")
    ends = rows.groupBy("uri").agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("versions")
    )
    return rows.join(ends, "uri")


def portal_as_of(runs: DataFrame, snapshot: int) -> DataFrame:
    """The newest run of each portal up to a snapshot, for portals missing in it."""
    return as_of(runs, snapshot, ("portalid",))


def stored_location(crawllog: DataFrame, uri: str, digest: str) -> DataFrame:
    return crawllog.where((F.col("uri") == uri) & (F.col("digest") == digest)).select("disklocation")


def stored_locations(wanted: DataFrame, crawllog: DataFrame) -> DataFrame:
    """One location for every wanted (uri, digest)."""
    first = crawllog.groupBy("uri", "digest").agg(F.min_by("disklocation", F.struct("timestamp", "event_id")).alias("disklocation"))
    return wanted.select("uri", "digest").distinct().join(first, ["uri", "digest"])


