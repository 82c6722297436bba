"""Tables of the catalogue joined on their keys, with the filters callers ask for.

All joins are equi joins on columns; the physical join is left to Spark, which broadcasts a
side only when its size allows it and splits skewed partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.functions.ratios import change_ratios, resource_filter
from catascope.functions.status import status_class
from catascope.functions.text import duration_seconds
from catascope.functions.urls import landing_page


def scope(df: DataFrame, snapshot: int | None = None, portalid: str | None = None, organisation: str | None = None) -> DataFrame:
    """Rows of a snapshot, portal or organisation; a filter that is not given does not filter."""
    for name, wanted in (("snapshot", snapshot), ("portalid", portalid), ("organisation", organisation)):
        if wanted is not None:
            df = df.where(F.col(name) == wanted)
    return df


def portals(table: DataFrame, software: str | None = None, iso: str | None = None, active: bool | None = None) -> DataFrame:
    for name, wanted in (("software", software), ("iso", iso), ("active", active)):
        if wanted is not None:
            table = table.where(F.col(name) == wanted)
    return table


def snapshots(runs: DataFrame, portalid: str | None = None) -> DataFrame:
    return scope(runs, portalid=portalid).select("portalid", "snapshot").distinct()


def datasets(table: DataFrame, snapshot: int | None = None, portalid: str | None = None) -> DataFrame:
    """Datasets of a portal and snapshot; a stored table reads only that week."""
    return scope(table, snapshot, portalid).select("portalid", "snapshot", "id", "organisation", "title", "md5")


def id_union(table: DataFrame, *snapshots_: int) -> DataFrame:
    """Ids that occur in any of the snapshots."""
    return table.where(F.col("snapshot").isin(*snapshots_)).select("portalid", "id").distinct()


def id_difference(table: DataFrame, current: int, previous: int) -> DataFrame:
    """Ids of one snapshot that the other does not have."""
    ids = lambda sn: scope(table, sn).select("portalid", "id")
    return ids(current).join(ids(previous), ["portalid", "id"], "left_anti")


def weights(datasets: DataFrame, *by: str) -> DataFrame:
    """Occurrences w of every content per group: the small form of the dataset side.

    Copies of one content collapse before the shuffle, so a content that fills a third of the
    table meets its resources once per group and not once per dataset.
    """
    return datasets.groupBy(*by, "md5").agg(F.count(F.lit(1)).alias("w"))


def meta_resources(datasets: DataFrame, resources: DataFrame, snapshot=None, portalid=None, organisation=None, max_size: int | None = None) -> DataFrame:
    """Resources of the datasets, once per dataset that describes them."""
    ds = scope(datasets, snapshot, portalid, organisation).select("portalid", "snapshot", "id", "title", "md5")
    return resources.where(resource_filter(max_size=max_size)).join(ds, "md5")


def resource_infos(datasets: DataFrame, resources: DataFrame, lookups: DataFrame, snapshot=None, portalid=None, organisation=None) -> DataFrame:
    """Lookups of the resources of the datasets with the dataset's id and title."""
    ds = scope(datasets, snapshot, portalid, organisation).select("portalid", "snapshot", "id", "title", "md5")
    described = resources.select("uri", "md5").join(ds, "md5").drop("md5")
    return scope(lookups, snapshot).join(described, ["uri", "snapshot"])


def data_resources(datasets: DataFrame, resources: DataFrame, snapshot=None, portalid=None, format: str | None = None) -> DataFrame:
    """Valid resources with dataset id and content."""
    ds = scope(datasets, snapshot, portalid).select("portalid", "snapshot", "id", "md5")
    mr = resources.where(resource_filter(format=format, valid=True)).select("uri", "md5")
    return mr.join(ds, "md5").select("portalid", "snapshot", "uri", "id", "md5")


def csv_resources(datasets: DataFrame, resources: DataFrame, snapshot=None, portalid=None) -> DataFrame:
    ds = scope(datasets, snapshot, portalid).select("portalid", "snapshot", "id", "title", "md5")
    mr = resources.where(F.col("format") == "csv").select("uri", "md5", "size")
    return mr.join(ds, "md5").select("portalid", "snapshot", "id", "title", "uri", "size")


def portals_all(runs: DataFrame, quality: DataFrame, portals: DataFrame, snapshot=None) -> DataFrame:
    """Every run with its quality row if there is one, and its portal."""
    return (
        scope(runs, snapshot)
        .join(quality, ["portalid", "snapshot"], "left")
        .join(portals.withColumnRenamed("id", "portalid"), "portalid")
    )


def portals_quality(quality: DataFrame, portals: DataFrame, counts: DataFrame, snapshot=None) -> DataFrame:
    """Quality rows with their portal and the portal's latest counts."""
    p = portals.withColumnRenamed("id", "portalid").join(counts, "portalid", "left")
    return scope(quality, snapshot).join(p, "portalid")


def dashboard(portals: DataFrame, runs: DataFrame, quality: DataFrame, dynamics: DataFrame | None = None) -> DataFrame:
    """Portal, run, quality and, if wanted, change row per portal and snapshot."""
    rows = runs.join(quality, ["portalid", "snapshot"])
    if dynamics is not None:
        rows = rows.join(dynamics, ["portalid", "snapshot"])
    rows = rows.join(portals.withColumnRenamed("id", "portalid"), "portalid")
    return rows.withColumn("duration", duration_seconds(F.col("start_ts"), F.col("end_ts")))


def portal_dynamics(portals: DataFrame, dynamics: DataFrame, snapshot=None, up_to: int | None = None) -> DataFrame:
    """Change rows of the portals with their ratios, of one snapshot or as a series."""
    rows = scope(dynamics, snapshot)
    if up_to is not None:
        rows = rows.where(F.col("snapshot") <= up_to)
    ratios = change_ratios(*[F.col(c) for c in ("added", "deleted", "updated", "static", "intersected")])
    return rows.join(portals.withColumnRenamed("id", "portalid"), "portalid").withColumns(ratios)


def document_resources(resources: DataFrame, lookups: DataFrame, snapshot: int, md5: str | None = None) -> DataFrame:
    """Resources of documents with their lookup in a snapshot if there was one."""
    mr = resources if md5 is None else resources.where(F.col("md5") == md5)
    found = scope(lookups, snapshot).select("uri", "status", F.col("timestamp").alias("looked_up"))
    return mr.join(found, "uri", "left")


def license_search(datasets: DataFrame, resources: DataFrame, content: DataFrame, uri: str | None = None, snapshot=None) -> DataFrame:
    """Datasets and licenses describing a uri."""
    mr = resources if uri is None else resources.where(F.col("uri") == uri)
    found = mr.select("uri", "md5").join(content.select("md5", "license"), "md5")
    ds = scope(datasets, snapshot).select("portalid", "snapshot", "id", "title", "md5")
    return found.join(ds, "md5").select("uri", "portalid", "snapshot", "id", "title", "license")


def documents(datasets: DataFrame, content: DataFrame, snapshot=None, portalid=None, ids: DataFrame | None = None) -> DataFrame:
    """Content of datasets; ids is a table of (portalid, id) to look up."""
    ds = scope(datasets, snapshot, portalid)
    if ids is not None:
        ds = ds.join(ids.select("portalid", "id").distinct(), ["portalid", "id"], "left_semi")
    return ds.select("portalid", "snapshot", "id", "md5").join(content, "md5")


def dataset_quality(datasets: DataFrame, quality: DataFrame, snapshot=None, portalid=None, dataset_id: str | None = None) -> DataFrame:
    ds = scope(datasets, snapshot, portalid)
    if dataset_id is not None:
        ds = ds.where(F.col("id") == dataset_id)
    return ds.select("portalid", "snapshot", "id", "md5").join(quality, "md5")


def organisation_content(datasets: DataFrame, content: DataFrame, quality: DataFrame, snapshot=None, portalid=None, organisation=None) -> DataFrame:
    ds = scope(datasets, snapshot, portalid, organisation).select("portalid", "snapshot", "id", "organisation", "md5")
    return ds.join(content.drop("organisation"), "md5").join(quality, "md5")


def _valid_uris(datasets: DataFrame, resources: DataFrame, *extra: str) -> DataFrame:
    ds = datasets.select("portalid", "snapshot", "id", "md5")
    mr = resources.where(F.col("valid")).select("uri", "md5", *extra)
    return mr.join(ds, "md5")


def unfetched_resources(datasets: DataFrame, resources: DataFrame, lookups: DataFrame, portals: DataFrame, snapshot=None, portalid=None, iso: str | None = None, exclude_iso: str | None = None, batch: int | None = None) -> DataFrame:
    """Valid resources without a lookup in the snapshot, each uri once per portal."""
    p = portals.select(F.col("id").alias("portalid"), "iso")
    if iso is not None:
        p = p.where(F.col("iso") == iso)
    if exclude_iso is not None:
        p = p.where(F.col("iso") != exclude_iso)
    ds = weights(scope(datasets, snapshot, portalid), "portalid", "snapshot").join(p, "portalid", "left_semi")
    mr = resources.where(F.col("valid")).select("uri", "md5")
    wanted = mr.join(ds, "md5").select("portalid", "snapshot", "uri").distinct()
    left = wanted.join(scope(lookups, snapshot).select("uri", "snapshot"), ["uri", "snapshot"], "left_anti")
    return left if batch is None else left.orderBy("snapshot", "portalid", "uri").limit(batch)


def undownloaded_resources(datasets: DataFrame, resources: DataFrame, downloads: DataFrame, snapshot=None, portalid=None, format: str | None = None, batch: int | None = None) -> DataFrame:
    """Valid resources without a download in the snapshot; the limit comes after all filters."""
    rows = _valid_uris(scope(datasets, snapshot, portalid), resources, "format")
    if format is not None:
        rows = rows.where(F.col("format") == format)
    left = rows.join(scope(downloads, snapshot).select("uri", "snapshot"), ["uri", "snapshot"], "left_anti")
    left = left.select("portalid", "snapshot", "uri", "id", "md5")
    return left if batch is None else left.orderBy("snapshot", "portalid", "id", "uri").limit(batch)


def portals_to_repair(portals: DataFrame, runs: DataFrame, snapshot: int) -> DataFrame:
    """Portals without a successful run in the snapshot."""
    done = scope(runs, snapshot).where(F.col("status") == 200).select("portalid")
    return portals.select(F.col("id").alias("portalid")).join(done, "portalid", "left_anti")


def known(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Keys of a batch that exist in a table: one semi join instead of a probe per row."""
    return keys.join(table.select(*on), on, "left_semi")


def snapshot_pairs(datasets: DataFrame, current: int, previous: int, portalid: str | None = None) -> DataFrame:
    """Full outer comparison of two snapshots on (portalid, id)."""
    def side(sn: int, name: str) -> DataFrame:
        return scope(datasets, sn, portalid).select("portalid", "id", F.col("md5").alias(name), F.lit(True).alias(f"_in_{name}"))

    rows = side(current, "md5").join(side(previous, "md5_previous"), ["portalid", "id"], "full_outer")
    kind = (
        F.when(F.col("_in_md5_previous").isNull(), "added")
        .when(F.col("_in_md5").isNull(), "deleted")
        .when(~F.col("md5").eqNullSafe(F.col("md5_previous")), "updated")
        .otherwise("static")
    )
    return rows.select("portalid", "id", "md5", "md5_previous", kind.alias("change"))


def run_pairs(runs: DataFrame, current: int, previous: int) -> DataFrame:
    """Runs of the portals in two snapshots side by side."""
    cols = ["status", "datasetcount", "resourcecount"]
    a = scope(runs, current).select("portalid", *cols)
    b = scope(runs, previous).select("portalid", *[F.col(c).alias(c + "_previous") for c in cols])
    return a.join(b, "portalid")


def evolution(runs: DataFrame, quality: DataFrame, portalid: str | None = None) -> DataFrame:
    """Runs with their quality per snapshot."""
    return scope(runs, portalid=portalid).join(quality, ["portalid", "snapshot"], "left")


def lookup_history(lookups: DataFrame, uri: str | None = None) -> DataFrame:
    """Lookups over all snapshots, of one uri or of every one."""
    return lookups if uri is None else lookups.where(F.col("uri") == uri)


def link_check(datasets: DataFrame, resources: DataFrame, lookups: DataFrame, portals: DataFrame, snapshot=None, portalid=None, organisation=None) -> DataFrame:
    """Rows of the link check page: lookup, landing page of the dataset and status class."""
    rows = resource_infos(datasets, resources, lookups, snapshot, portalid, organisation)
    p = portals.select(F.col("id").alias("portalid"), "software", F.col("uri").alias("portal_uri"), "apiuri")
    rows = rows.join(p, "portalid")
    return rows.select(
        "portalid", "snapshot", "uri", "status", "id", "title",
        landing_page(F.col("software"), F.col("portal_uri"), F.col("apiuri"), F.col("id")).alias("dataset_uri"),
        status_class(F.col("status")).alias("status_class"),
    )
