"""Reference registries landed as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope.functions.licenses import NOT_FOUND
from catascope.functions.text import filled, normalise_format


def read_media_types(spark: SparkSession, csv_path: str, suffix_path: str | None = None) -> DataFrame:
    """Tokens (column token) of a media type registry.

    csv_path: files with the columns Name and Template. suffix_path: a JSON list of
    one-entry objects from suffix to media type; a suffix counts if its type is registered.
    """
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(csv_path).select("Name", "Template")
    names = rows.select(normalise_format(F.col("Name")).alias("token"))
    types = rows.select(F.lower(F.trim("Template")).alias("token"))
    out = names.unionByName(types)
    if suffix_path:
        pairs = spark.read.text(suffix_path, wholetext=True).select(
            F.explode(F.from_json("value", "array<map<string,string>>")).alias("m")
        ).select(F.explode("m").alias("suffix", "type"))
        known = types.where(filled(F.col("token"))).distinct()
        suffixes = pairs.join(known, F.col("type") == F.col("token"), "left_semi")
        out = out.unionByName(suffixes.select(F.expr("substring(suffix, 2)").alias("token")))
    return out.where(filled(F.col("token"))).distinct()


def read_licenses(spark: SparkSession, path: str) -> DataFrame:
    """License registry: a JSON object from id to {title, url, od_conformance}."""
    table = "map<string,struct<title:string,url:string,od_conformance:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", table)).alias("id", "l"))
    return rows.select(
        "id", "l.title", "l.url", F.coalesce("l.od_conformance", F.lit(NOT_FOUND)).alias("conformance")
    )


def license_table(spark: SparkSession) -> DataFrame:
    """The small built-in registry as a table."""
    from catascope.functions.licenses import OPEN_LICENSE_LABELS, REGISTRY

    rows = [(*r, r[0] in OPEN_LICENSE_LABELS) for r in REGISTRY]
    return spark.createDataFrame(rows, "id string, title string, url string, conformance string, listed_open boolean")
