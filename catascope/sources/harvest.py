"""Landed responses of the portal interfaces to one record per dataset.

Input pages are rows (portalid, snapshot, page, body): the JSON text of one response and its
number. Output records are (portalid, snapshot, id, raw) with the first mention of an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope.functions import documents as doc
from catascope.functions.text import filled
from catascope.operators import graphs
from catascope.session import staged

RUN = ["portalid", "snapshot"]


def write_pages(pages: DataFrame, path: str) -> None:
    """Responses (portalid, snapshot, page, body) below portalid=<id>/snapshot=<YYWW>/, many to a file, one per line."""
    pages.select(*RUN, "page", "body").write.partitionBy(*RUN).json(path)


def read_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Responses below portalid=<id>/snapshot=<YYWW>/, as <page>.json or in page=<page> folders.

    With lines, files hold many of them, a line {page, body} each: a crawl of any size lands in few
    files, and listing them costs the driver nothing that grows with the number of pages.
    """
    if lines:
        rows = spark.read.schema("portalid string, snapshot int, page int, body string").option("maxStringLen", 2**31 - 1).json(path)
        return rows.select(*RUN, "page", "body")
    file = F.input_file_name()
    number = F.coalesce(F.nullif(F.regexp_extract(file, "/page=([0-9]+)/", 1), F.lit("")), F.regexp_extract(file, r"([0-9]+)\.[^./]*$", 1))
    return spark.read.text(path, wholetext=True).select(
        "portalid",
        F.col("snapshot").cast("int").alias("snapshot"),
        number.cast("int").alias("page"),
        F.col("value").alias("body"),
    )


#: Where a page has its records, per software; the first place that there is counts.
PLACES = {
    "CKAN": ("$.result.results", "$.results", "$.result"),
    "Socrata": ("$",),
    "OpenDataSoft": ("$.datasets",),
    "DataGouvFr": ("$.data",),
}


def _found(software: str) -> Column:
    return F.coalesce(*[F.try_variant_get("_doc", p, "array<variant>") for p in PLACES[software]])


def rejected_pages(pages: DataFrame, software: str) -> DataFrame:
    """Pages that give no records: (portalid, snapshot, page, reason).

    Reasons are `empty` (no text), `not JSON` (a cut-off page, say) and `no records` (another
    answer, such as an error message).
    """
    rows = pages.withColumn("_doc", F.try_parse_json("body"))
    reason = (
        F.when(~filled(F.trim("body")), "empty")
        .when(F.col("_doc").isNull(), "not JSON")
        .when(_found(software).isNull(), "no records")
    )
    return rows.select(*RUN, "page", reason.alias("reason")).where(F.col("reason").isNotNull())


def runs_with_rejects(runs: DataFrame, rejects: DataFrame) -> DataFrame:
    """Runs with the number of rejected pages, and an exception where there was none but a reject."""
    n = rejects.groupBy(*RUN).agg(F.count(F.lit(1)).alias("rejected"), F.min("reason").alias("_reason"))
    out = runs.drop("rejected").join(n, RUN, "left")
    exc = F.coalesce("exc", F.when(F.col("rejected") > 0, F.concat(F.lit("ValueError: "), F.col("_reason"))))
    return out.withColumns({"exc": exc, "rejected": F.coalesce("rejected", F.lit(0))}).drop("_reason")


def _exploded(pages: DataFrame, software: str) -> DataFrame:
    parsed = pages.withColumn("_doc", F.try_parse_json("body"))
    found = _found(software)
    return parsed.select(*RUN, "page", F.posexplode(found).alias("pos", "item"))


def _first_per_id(rows: DataFrame, key: Column, raw: Column, *more: Column) -> DataFrame:
    """The first record of every id, with more columns of it. Ids are counted without their documents; only
    of ids that come again are records compared."""
    named = rows.select(*RUN, key.alias("id"), F.struct("page", "pos").alias("_at"), raw.alias("raw"), *more).where(filled(F.col("id")))
    again = named.groupBy(*RUN, "id").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first")).where("n > 1").drop("n")
    again = staged(again, "repeated-ids")
    columns = [c for c in named.columns if c != "_at"]
    once = named.join(again.select(*RUN, "id"), [*RUN, "id"], "left_anti").select(*columns)
    first = named.join(again, [*RUN, "id"]).where(F.col("_at") == F.col("_first")).select(*columns)
    return once.unionByName(first)


def ckan_records(pages: DataFrame, singles: DataFrame | None = None) -> DataFrame:
    """Search results, completed by single records whose id and name were not in them.

    Names are taken out before anything is joined, so that where documents are not asked for, none move.
    """
    rows = _exploded(pages, "CKAN")
    name = F.get_json_object(F.to_json("item"), "$.name").alias("name")
    found = _first_per_id(rows, doc.get(F.col("item"), "id"), F.to_json("item"), name)
    out = found.drop("name")
    if singles is None:
        return out
    one = singles.withColumn("_doc", F.try_parse_json("body"))
    result = F.coalesce(F.try_variant_get("_doc", "$.result", "variant"), F.col("_doc"))
    one = one.select(*RUN, "page", F.lit(0).alias("pos"), result.alias("item"))
    extra = _first_per_id(one, doc.get(F.col("item"), "id"), F.to_json("item"), name)
    seen = found.select(*RUN, "name").where(filled(F.col("name"))).distinct()
    extra = extra.join(out.select(*RUN, "id"), [*RUN, "id"], "left_anti")
    extra = extra.join(seen, [*RUN, "name"], "left_anti")
    return out.unionByName(extra.select(*out.columns))


def socrata_records(pages: DataFrame, dcat: DataFrame | None = None) -> DataFrame:
    """Tabular views as {view, dcat}; dcat is a table (portalid, snapshot, id, dcat)."""
    rows = _exploded(pages, "Socrata").where(
        F.coalesce(doc.get(F.col("item"), "viewType"), F.lit("tabular")) == "tabular"
    )
    out = _first_per_id(rows, doc.get(F.col("item"), "id"), F.to_json("item"))
    if dcat is None:
        out = out.withColumn("dcat", F.lit(None).cast("string"))
    else:
        text = dcat.groupBy(*RUN, "id").agg(F.min("dcat").alias("dcat"))
        out = out.join(text, [*RUN, "id"], "left")
    quoted = F.to_json(F.struct("dcat"))
    tail = F.when(F.col("dcat").isNull(), F.lit('{"dcat":null')).otherwise(F.regexp_replace(quoted, r"\}$", ""))
    return out.select(*RUN, "id", F.concat(tail, F.lit(',"view":'), "raw", F.lit("}")).alias("raw"))


def opendatasoft_records(pages: DataFrame) -> DataFrame:
    rows = _exploded(pages, "OpenDataSoft")
    return _first_per_id(rows, doc.get(F.col("item"), "datasetid"), F.to_json("item"))


def data_gouv_fr_records(pages: DataFrame) -> DataFrame:
    rows = _exploded(pages, "DataGouvFr")
    return _first_per_id(rows, doc.get(F.col("item"), "id"), F.to_json("item"))


def read_xml_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Triples of RDF/XML catalogues below portalid=/snapshot= folders."""
    return graphs.read_catalogues(spark, path)


def xml_records(catalogue: DataFrame) -> DataFrame:
    """One JSON-LD document per dataset of the catalogues' triples, with all that it reaches."""
    return graphs.documents(catalogue)


RECORDS = {
    "CKAN": ckan_records,
    "Socrata": socrata_records,
    "OpenDataSoft": opendatasoft_records,
    "DataGouvFr": data_gouv_fr_records,
    "XMLDCAT": xml_records,
}


def with_normal_extras(records: DataFrame) -> DataFrame:
    """Extras of a record as a map column, whichever way the portal wrote them."""
    return records.withColumn("extras", doc.extras_map(F.try_parse_json("raw")))
