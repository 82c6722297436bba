"""schema.org documents of DCAT rows, their pages, lists and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.functions.snapshot import monday_of
from catascope.functions.text import filled


def _first(name: str) -> Column:
    return F.get(F.col(name), F.lit(0))


def _ref(name: str) -> Column:
    return F.get(F.transform(F.col(name), lambda n: n["ref"]), F.lit(0))


def _some(c: Column) -> Column:
    return F.when(filled(c), c)


def schema_org(dcat: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document per row; needs portal_uri, iso and software beside the DCAT columns."""
    pub, contact = F.get("publisher", F.lit(0)), F.get("contact", F.lit(0))
    ref = F.coalesce(pub["ref"], contact["ref"])
    publisher = F.when(
        pub.isNotNull(),
        F.struct(
            F.lit("Organization").alias("@type"),
            F.when(~ref.startswith("_:"), ref).alias("@id"),
            F.coalesce(_some(pub["name"]), _some(contact["fn"])).alias("name"),
            F.coalesce(_some(pub["mbox"]), _some(contact["email"])).alias("email"),
            _some(pub["homepage"]).alias("url"),
        ),
    )

    def download(d: Column) -> Column:
        at = lambda n: F.get(d[n], F.lit(0))
        lic, fmt = at("license"), at("format")
        return F.struct(
            F.lit("DataDownload").alias("@type"),
            d["ref"].alias("@id"),
            at("title").alias("name"),
            at("description").alias("description"),
            at("modified").alias("dateModified"),
            at("issued").alias("datePublished"),
            F.coalesce(fmt["label"], fmt["value"], fmt["ref"]).alias("encodingFormat"),
            at("byte_size").alias("contentSize"),
            at("media_type").alias("fileFormat"),
            F.coalesce(at("access_url"), at("download_url")).alias("contentUrl"),
            F.when(lic["ref"].startswith("_:"), F.coalesce(lic["label"], lic["identifier"]))
            .otherwise(lic["ref"])
            .alias("license"),
        )

    document = F.struct(
        F.lit("http://schema.org").alias("@context"),
        F.lit("Dataset").alias("@type"),
        F.col("uri").alias("@id"),
        F.struct(
            F.lit("DataCatalog").alias("@type"),
            F.col("portal_uri").alias("@id"),
            F.col("portal_uri").alias("url"),
            F.col("iso").alias("spatialCoverage"),
            F.concat(F.lit("Underlying software: "), F.col("software")).alias("description"),
        ).alias("catalog"),
        publisher.alias("publisher"),
        _first("title").alias("name"),
        _first("description").alias("description"),
        _first("landing_page").alias("url"),
        _ref("spatial").alias("spatialCoverage"),
        _ref("temporal").alias("datasetTimeInterval"),
        _first("theme").alias("about"),
        _first("modified").alias("dateModified"),
        _first("issued").alias("datePublished"),
        _first("language").alias("inLanguage"),
        F.when(F.size("keywords") > 0, F.col("keywords")).alias("keywords"),
        F.transform("distributions", download).alias("distribution"),
    )
    return dcat.select(*keys, F.to_json(document, {"ignoreNullFields": "true"}).alias("doc"))


def file_name(dataset_id: Column) -> Column:
    """URL-safe base64 of the id."""
    return F.translate(F.base64(F.encode(dataset_id, "UTF-8")), "+/", "-_")


def pages(docs: DataFrame) -> DataFrame:
    """HTML page per dataset around its JSON document."""
    html = F.concat(
        F.lit('<!DOCTYPE html><html><script type="application/ld+json">'), F.col("doc"), F.lit("</script></html>")
    )
    return docs.select("portalid", file_name(F.col("id")).alias("file"), html.alias("value"))


def site_list(datasets: DataFrame) -> DataFrame:
    """Name (title, else id) and file of every dataset."""
    return datasets.select(
        "portalid",
        "snapshot",
        F.coalesce(_some(F.col("title")), F.col("id")).alias("name"),
        file_name(F.col("id")).alias("file"),
    )


def sitemap(datasets: DataFrame, content: DataFrame, location: str) -> DataFrame:
    """Sitemap entry per dataset; modification dates before 1980 are left out."""
    rows = datasets.join(content.select("md5", "modified"), "md5", "left")
    return rows.select(
        "portalid",
        "snapshot",
        F.lit("weekly").alias("changefreq"),
        F.when(
            F.col("modified") >= F.lit("1980-01-01").cast("timestamp"), F.date_format("modified", "yyyy-MM-dd")
        ).alias("lastmod"),
        F.concat(F.lit(location + "/"), F.col("portalid"), F.lit("/"), file_name(F.col("id"))).alias("loc"),
    )


def sitemap_index(runs: DataFrame, location: str) -> DataFrame:
    """Entry per portal and snapshot, dated by the Monday of the week."""
    return runs.select(
        F.col("portalid").alias("pid"),
        "snapshot",
        F.date_format(monday_of(F.col("snapshot")), "yyyy-MM-dd").alias("lastmod"),
        F.concat(F.lit(location + "/"), F.col("portalid"), F.lit("/sitemap.xml")).alias("loc"),
    ).distinct()


def organisation_links(datasets: DataFrame, location: str) -> DataFrame:
    """Report link of every organisation of a portal."""
    return (
        datasets.where(F.col("organisation").isNotNull())
        .select("portalid", "snapshot", "organisation")
        .distinct()
        .withColumn(
            "link",
            F.concat(
                F.lit(location + "/portal/"), F.col("portalid"), F.lit("/"), F.col("snapshot").cast("string"),
                F.lit("/report/"), F.url_encode("organisation"),
            ),
        )
    )
