"""Distributions, counts and totals over the catalogue tables.

Datasets are reduced to occurrences per content before they meet resources or scores; all
results are sums of those weights, equal to counting the joined rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catascope.functions.urls import domain
from catascope.operators.joins import scope, weights

GROUP = ("snapshot",)


def _count(w: str = "w") -> Column:
    return F.sum(w).cast("bigint").alias("count")


def _ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Largest count first, the keys break ties."""
    return df.orderBy(F.desc("count"), *keys)


def status_dist(datasets: DataFrame, resources: DataFrame, lookups: DataFrame, by=GROUP, snapshot=None, portalid=None, organisation=None, ordered: bool = False) -> DataFrame:
    by = list(dict.fromkeys((*by, "snapshot")))
    ds = weights(scope(datasets, snapshot, portalid, organisation), *by)
    per_uri = resources.select("uri", "md5").join(ds, "md5").groupBy(*by, "uri").agg(F.sum("w").alias("w"))
    found = per_uri.join(scope(lookups, snapshot).select("uri", "snapshot", "status"), ["uri", "snapshot"])
    out = found.groupBy(*by, "status").agg(_count())
    return _ordered(out, *by, "status") if ordered else out


def organisation_dist(datasets: DataFrame, by=GROUP, snapshot=None, portalid=None) -> DataFrame:
    return scope(datasets, snapshot, portalid).groupBy(*by, "organisation").agg(F.count(F.lit(1)).alias("count"))


def format_dist(datasets: DataFrame, resources: DataFrame, by=GROUP, snapshot=None, portalid=None, portals: DataFrame | None = None, iso: str | None = None, software: str | None = None) -> DataFrame:
    ds = scope(datasets, snapshot, portalid)
    if portals is not None:
        p = portals.select(F.col("id").alias("portalid"), "iso", "software")
        p = p if iso is None else p.where(F.col("iso") == iso)
        p = p if software is None else p.where(F.col("software") == software)
        ds = ds.join(p, "portalid")
    formats = resources.groupBy("md5", "format").agg(F.count(F.lit(1)).alias("n"))
    joined = weights(ds, *by).join(formats, "md5")
    return joined.groupBy(*by, "format").agg(F.sum(F.col("w") * F.col("n")).cast("bigint").alias("count"))


def license_dist(datasets: DataFrame, content: DataFrame, by=GROUP, snapshot=None, portalid=None) -> DataFrame:
    ds = weights(scope(datasets, snapshot, portalid), *by)
    return ds.join(content.select("md5", "license"), "md5").groupBy(*by, "license").agg(_count())


def valid_url_dist(datasets: DataFrame, resources: DataFrame, by=GROUP, snapshot=None, portalid=None, organisation=None) -> DataFrame:
    """Count of rows and of non-null flags per flag."""
    ds = weights(scope(datasets, snapshot, portalid, organisation), *by)
    flags = resources.groupBy("md5", "valid").agg(F.count(F.lit(1)).alias("n"), F.count("valid").alias("nn"))
    return ds.join(flags, "md5").groupBy(*by, "valid").agg(
        F.sum(F.col("w") * F.col("n")).cast("bigint").alias("count"),
        F.sum(F.col("w") * F.col("nn")).cast("bigint").alias("judged"),
    )


def distinct_formats(datasets: DataFrame, resources: DataFrame, by=GROUP) -> DataFrame:
    return format_dist(datasets, resources, by).select(*by, "format").distinct()


def distinct_licenses(datasets: DataFrame, content: DataFrame, by=GROUP) -> DataFrame:
    return license_dist(datasets, content, by).select(*by, "license").distinct()


def distinct_organisations(datasets: DataFrame, by=GROUP) -> DataFrame:
    return datasets.select(*by, "organisation").distinct()


def distinct_numbers(datasets: DataFrame, resources: DataFrame, content: DataFrame, by=GROUP) -> DataFrame:
    """Number of distinct formats, licenses and organisations; null counts as a value."""
    def number(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))

    return (
        number(distinct_organisations(datasets, by), "organisations")
        .join(number(distinct_formats(datasets, resources, by), "formats"), list(by), "left")
        .join(number(distinct_licenses(datasets, content, by), "licenses"), list(by), "left")
    )


def portal_stats(runs: DataFrame, portals: DataFrame | None = None, active_only: bool = True) -> DataFrame:
    """Snapshots, first, last and latest counts per portal."""
    stats = runs.groupBy("portalid").agg(
        F.count("snapshot").alias("sn_count"),
        F.min("snapshot").alias("sn_first"),
        F.max("snapshot").alias("sn_last"),
        F.max_by("datasetcount", "snapshot").alias("datasetcount"),
        F.max_by("resourcecount", "snapshot").alias("resourcecount"),
    )
    if portals is None:
        return stats
    p = portals.withColumnRenamed("id", "portalid")
    return (p.where("active") if active_only else p).join(stats, "portalid", "left")


def top_n(dist: DataFrame, value: str, n: int = 3, by=("portalid", "snapshot")) -> DataFrame:
    """The n largest values of a distribution per group, the rest as Others, with shares.

    One window over the distribution, whose rows are values and not resources, gives rank, total
    and what the values up to a rank hold; the row of the last rank also brings the rest.
    """
    by = list(by)
    key = F.coalesce(F.col(value), F.lit("missing"))
    whole = W.partitionBy(*by)
    order = whole.orderBy(F.desc("count"), F.asc_nulls_last(value))
    rows = dist.withColumns(
        {
            "rank": F.row_number().over(order),
            "t": F.sum("count").over(order.rowsBetween(W.unboundedPreceding, 0)),
            "total": F.sum("count").over(whole),
            "distinct_values": F.count(F.lit(1)).over(whole),
        }
    ).where(F.col("rank") <= n)
    item = F.struct(key.alias("value"), F.col("count"), F.col("rank"))
    rest = F.struct(F.lit("Others").alias("value"), (F.col("total") - F.col("t")).alias("count"), F.lit(n + 1).alias("rank"))
    ends = (F.col("rank") == n) & (F.col("total") != F.col("t"))
    every = F.when(ends, F.array(item, rest)).otherwise(F.array(item))
    share = F.when(F.col("total") > 0, F.col("count") / F.col("total")).otherwise(F.lit(0.0))
    return rows.select(*by, "total", "distinct_values", F.inline(every)).select(
        *by, "value", "count", share.alias("perc"), "rank", "distinct_values"
    )


def format_dist_groupings(datasets: DataFrame, resources: DataFrame, portals: DataFrame, snapshot=None) -> DataFrame:
    """Format counts by portal, country and software from one pass over the joined counts."""
    base = format_dist(
        datasets, resources, ("portalid", "snapshot", "iso", "software"), snapshot, portals=portals
    ).withColumn("format", F.coalesce("format", F.lit("missing")))
    c = F.col
    # grouping(x) is 1 where a row is not grouped by x: a null of x itself is a value
    of = lambda name: F.grouping(name) == 0
    sets = [
        [c("snapshot"), c("format"), c("portalid")],
        [c("snapshot"), c("format"), c("iso")],
        [c("snapshot"), c("format"), c("software")],
    ]
    grouped = base.groupingSets(sets, "snapshot", "format", "portalid", "iso", "software").agg(
        F.sum("count").cast("bigint").alias("count"),
        F.when(of("portalid"), "portal").when(of("iso"), "iso").otherwise("software").alias("level"),
    )
    named = F.when(c("level") == "portal", c("portalid")).when(c("level") == "iso", c("iso")).otherwise(c("software"))
    return grouped.select("format", "snapshot", named.alias("grouping"), "level", "count")


def quality_means(quality: DataFrame, portals: DataFrame, by: str, metrics: list[str], snapshot=None) -> DataFrame:
    """Mean of the portals' metrics by country or software, with the group's size."""
    rows = scope(quality, snapshot).join(portals.withColumnRenamed("id", "portalid"), "portalid")
    return rows.groupBy("snapshot", by).agg(
        *[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("count")
    )


def system_evolution(runs: DataFrame, portals: DataFrame) -> DataFrame:
    p = portals.select(F.col("id").alias("portalid"), "software")
    return runs.join(p, "portalid").groupBy("snapshot", "software").agg(
        F.count(F.lit(1)).alias("portals"),
        F.sum("datasetcount").alias("datasets"),
        F.sum("resourcecount").alias("resources"),
    )


def harvest_counts(datasets: DataFrame, resources: DataFrame) -> DataFrame:
    """Datasets fetched and resources described per portal and snapshot."""
    per_content = resources.groupBy("md5").agg(F.count(F.lit(1)).alias("n"))
    rows = weights(datasets, "portalid", "snapshot").join(per_content, "md5", "left")
    return rows.groupBy("portalid", "snapshot").agg(
        F.sum("w").alias("datasetsfetched"),
        F.sum(F.col("w") * F.coalesce("n", F.lit(0))).alias("resourcecount"),
    )


def close_runs(runs: DataFrame, datasets: DataFrame, resources: DataFrame) -> DataFrame:
    """Run rows with the counts of what was harvested."""
    counts = harvest_counts(datasets, resources)
    out = runs.drop("datasetsfetched", "resourcecount").join(counts, ["portalid", "snapshot"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("datasetsfetched", "resourcecount")})


def version_ranges(datasets: DataFrame) -> DataFrame:
    """First and last snapshot of every version of a dataset."""
    return datasets.groupBy("portalid", "id", "md5").agg(
        F.min("snapshot").alias("sn_min"), F.max("snapshot").alias("sn_max"), F.count(F.lit(1)).alias("seen")
    )


def version_islands(datasets: DataFrame) -> DataFrame:
    """The same with one row per uninterrupted stay, for content that comes back."""
    w = W.partitionBy("portalid", "id").orderBy("snapshot")
    fresh = F.coalesce((~F.lag("md5").over(w).eqNullSafe(F.col("md5"))).cast("int"), F.lit(1))
    rows = datasets.select("portalid", "id", "snapshot", "md5").withColumn("fresh", fresh)
    rows = rows.withColumn("version", F.sum("fresh").over(w).cast("int"))
    return rows.groupBy("portalid", "id", "version", "md5").agg(
        F.min("snapshot").alias("sn_min"), F.max("snapshot").alias("sn_max")
    )


def active_portals(portals: DataFrame) -> DataFrame:
    return portals.groupBy().agg(F.count_if(F.col("active")).alias("active"), F.count(F.lit(1)).alias("portals"))


def value_counts(df: DataFrame, column: Column, by=()) -> DataFrame:
    return df.groupBy(*by, column.alias("value")).agg(F.count(F.lit(1)).alias("count"))


def link_check_totals(rows: DataFrame, by=("portalid", "snapshot")) -> DataFrame:
    """All, found, missing and other lookups."""
    status = F.col("status")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == 200).alias("ok"),
        F.count_if(status == 404).alias("missing"),
        F.count_if(~status.isin(200, 404) | status.isNull()).alias("other"),
    )


def seeds_per_domain(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy(domain(F.col("uri")).alias("domain")).agg(F.count(F.lit(1)).alias("count"))


def size_histogram(counts: DataFrame, value: str, bins: int = 9, by=("software",)) -> DataFrame:
    """Counts in log-spaced bins from 1 to the group's maximum; the last bin is closed."""
    top = counts.groupBy(*by).agg(F.max(value).alias("_top"))
    v, top_log = F.col(value), F.log10(F.col("_top").cast("double"))
    raw = F.floor(F.log10(v.cast("double")) / top_log * bins) + 1
    bin_no = F.when(v == F.col("_top"), bins).otherwise(F.least(raw, F.lit(bins))).cast("int")
    rows = counts.where(v >= 1).join(top, list(by)).withColumn("bin", bin_no)
    return rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"), F.min(value).alias("smallest"), F.max(value).alias("largest"))


def exceptions_by_type(lookups: DataFrame, by=GROUP) -> DataFrame:
    return lookups.where(F.col("exc").isNotNull()).groupBy(*by, "exc").agg(F.count(F.lit(1)).alias("count"))
