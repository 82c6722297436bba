"""Results as JSON, CSV, triples, pages and sitemaps. All writes are distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catascope.operators import graphs
from catascope.operators.mapping import DCAT
from catascope.operators.schema_org import pages
from catascope.operators.triples import n_triples
from catascope.session import staged


def write_json(df: DataFrame, path: str, drop_empty: bool = True) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", drop_empty).json(path)


def json_rows(df: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Rows as JSON text, with or without empty fields."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(drop_empty).lower()}).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_triples(triples: DataFrame, path: str, keys: tuple[str, ...] = ("portalid",)) -> None:
    """N-Triples, a folder per portal; N3 readers take these lines as they are."""
    n_triples(triples, list(keys)).write.mode("overwrite").partitionBy(*keys).text(path)


def write_json_ld(triples: DataFrame, path: str, document: str = "md5") -> None:
    """JSON-LD documents, one tree per line, a folder per portal. `document` tells the documents of a portal apart."""
    keys = ["portalid", document]
    graph = triples if "o_lang" in triples.columns else triples.withColumn("o_lang", F.lit(None).cast("string"))
    graph = staged(graph.select(*keys, *graphs.TERMS), "json-ld")
    docs = graphs.trees(graph, graphs.of_type(graph, keys, DCAT + "Dataset"), keys)
    docs.select("portalid", "value").write.mode("overwrite").partitionBy("portalid").text(path)


def write_pages(docs: DataFrame, path: str) -> None:
    """Pages as rows (file, value) of large files, a folder per portal; they are unpacked where they are served."""
    pages(docs).write.mode("overwrite").partitionBy("portalid").json(path)


def write_sitemap(entries: DataFrame, path: str, index: bool = False) -> None:
    """Sitemap as XML, a folder per portal, or the index over portals."""
    root, row = ("sitemapindex", "sitemap") if index else ("urlset", "url")
    cols = ["lastmod", "loc", "pid"] if index else ["portalid", "changefreq", "lastmod", "loc"]
    writer = entries.select(*cols).write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row)
    (writer if index else writer.partitionBy("portalid")).save(path)
