"""Values of a DCAT row: what the metrics, the resource table and the exports read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.functions.licenses import map_license
from catascope.functions.text import byte_size, filled, lenient_datetime, normalise_format
from catascope.functions.urls import normalise_url, repair_url, url_valid


def dataset_values(name: str) -> Column:
    """Values of a dataset property; nodes are given by their reference."""
    if name in ("contact", "publisher", "temporal", "spatial"):
        return F.transform(F.col(name), lambda n: n["ref"])
    return F.col(name)


def distribution_values(name: str) -> Column:
    """Values of a property over all distributions, URLs with doubled schemes repaired."""
    each = F.flatten(F.transform(F.col("distributions"), lambda d: d[name]))
    if name in ("license", "format"):
        return F.transform(each, lambda n: n["ref"])
    return F.transform(each, repair_url)


def distribution_formats() -> Column:
    """Label, else value of every format node."""
    nodes = F.flatten(F.transform(F.col("distributions"), lambda d: d["format"]))
    plain = lambda n: F.when(~n["ref"].startswith("_:"), n["ref"])
    return F.array_compact(
        F.transform(nodes, lambda n: F.coalesce(_some(n["label"]), _some(n["value"]), plain(n)))
    )


def _some(c: Column) -> Column:
    return F.when(filled(c), c)


def license_nodes() -> Column:
    return F.flatten(F.transform(F.col("distributions"), lambda d: d["license"]))


def contact_values() -> Column:
    """Names and addresses of the contact points."""
    each = F.transform(F.col("contact"), lambda n: F.array(_some(n["fn"]), _some(n["email"])))
    return F.array_compact(F.flatten(each))


def publisher_values() -> Column:
    """Mailbox, homepage and name of the publishers."""
    each = F.transform(
        F.col("publisher"), lambda n: F.array(_some(n["mbox"]), _some(n["homepage"]), _some(n["name"]))
    )
    return F.array_compact(F.flatten(each))


def organisation() -> Column:
    """Name of the first publisher that has one, else of the first contact."""
    first = lambda nodes, f: F.get(F.filter(F.transform(F.col(nodes), lambda n: n[f]), filled), F.lit(0))
    return F.coalesce(first("publisher", "name"), first("contact", "fn"))


def organisation_url() -> Column:
    first = lambda nodes: F.get(F.transform(F.col(nodes), lambda n: n["ref"]), F.lit(0))
    return F.coalesce(first("publisher"), first("contact"))


def first_license(registry=None) -> Column:
    """Mapped id of the first distribution license."""
    node = F.get(license_nodes(), F.lit(0))
    return F.when(node.isNotNull(), map_license(node["label"], node["identifier"], node["ref"], registry)["id"])


def resources(dcat: DataFrame) -> DataFrame:
    """Resources described by the documents: one row per md5 and uri, the first mention wins.

    A document's resources are deduplicated inside its own row, so nothing shuffles; callers
    pass one row per md5.
    """
    nothing = F.lit(None).cast("string")
    at = lambda d, name: F.get(d[name], F.lit(0))
    fmt = lambda d: F.get(d["format"], F.lit(0))

    def listed(urls: str) -> Column:
        def per_dist(d: Column) -> Column:
            f = fmt(d)
            literal = F.when(~f["ref"].startswith("_:"), f["ref"])
            return F.transform(
                d[urls],
                lambda u: F.struct(
                    normalise_url(repair_url(u)).alias("uri"),
                    url_valid(F.trim(repair_url(u))).alias("valid"),
                    normalise_format(F.coalesce(_some(f["label"]), _some(f["value"]), literal, nothing)).alias("format"),
                    at(d, "media_type").alias("media"),
                    byte_size(at(d, "byte_size")).alias("size"),
                    lenient_datetime(at(d, "issued")).alias("created"),
                    lenient_datetime(at(d, "modified")).alias("modified"),
                ),
            )

        return F.flatten(F.transform(F.col("distributions"), per_dist))

    found = F.filter(F.concat(listed("access_url"), listed("download_url")), lambda r: filled(r["uri"]))
    placed = F.transform(
        found, lambda r, i: F.struct(r["uri"].alias("uri"), i.alias("pos"), r.dropFields("uri").alias("r"))
    )
    rows = dcat.select("md5", F.array_sort(placed).alias("rs"))
    first = F.filter("rs", lambda r, i: (i == 0) | (r["uri"] != F.get(F.col("rs"), i - 1)["uri"]))
    # the outer form: Spark would repeat the whole mapping in a filter below the plain one
    return rows.select("md5", F.inline_outer(first)).where(F.col("uri").isNotNull()).select("uri", "md5", "r.*")


def content_rows(dcat: DataFrame, registry=None, extra: list | None = None) -> DataFrame:
    """One row per document: organisation, mapped license and the two dates."""
    return dcat.select(
        "md5",
        lenient_datetime(F.get("modified", F.lit(0))).alias("modified"),
        lenient_datetime(F.get("issued", F.lit(0))).alias("created"),
        organisation().alias("organisation"),
        first_license(registry).alias("license"),
        *(extra or []),
    )


def dataset_rows(dcat: DataFrame) -> DataFrame:
    return dcat.select(
        "id",
        "snapshot",
        "portalid",
        organisation().alias("organisation"),
        F.get("title", F.lit(0)).alias("title"),
        "md5",
    )
