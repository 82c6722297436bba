"""The registry of portals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope.functions.text import filled
from catascope.functions.urls import portal_id

# Two-letter codes of the three-letter ones registries use; others are cut by the caller's map.
ISO2 = {
    "ARG": "AR", "AUS": "AU", "AUT": "AT", "BEL": "BE", "BRA": "BR", "CAN": "CA", "CHE": "CH",
    "CHL": "CL", "COL": "CO", "CZE": "CZ", "DEU": "DE", "DNK": "DK", "ECU": "EC", "ESP": "ES",
    "EST": "EE", "FIN": "FI", "FRA": "FR", "GBR": "GB", "GRC": "GR", "HKG": "HK", "HRV": "HR",
    "HUN": "HU", "IDN": "ID", "IND": "IN", "IOT": "IO", "IRL": "IE", "ISL": "IS", "ITA": "IT",
    "JPN": "JP", "KEN": "KE", "KOR": "KR", "LTU": "LT", "LUX": "LU", "LVA": "LV", "MEX": "MX",
    "MNE": "ME", "NGA": "NG", "NLD": "NL", "NOR": "NO", "NZL": "NZ", "PER": "PE", "POL": "PL",
    "PRT": "PT", "PRY": "PY", "ROU": "RO", "RUS": "RU", "SRB": "RS", "SVK": "SK", "SVN": "SI",
    "SWE": "SE", "TUR": "TR", "TWN": "TW", "UGA": "UG", "UKR": "UA", "URY": "UY", "USA": "US",
    "ZAF": "ZA",
}


def country_code(code: Column, table: dict[str, str] | None = None) -> Column:
    pairs = [F.lit(x) for item in (table or ISO2).items() for x in item]
    up = F.upper(F.trim(code))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), up), F.when(F.length(up) == 2, up))


def portal_rows(df: DataFrame, countries: dict[str, str] | None = None) -> DataFrame:
    """Portal rows of (url, api, software, country); the api defaults to the url."""
    api = F.trim("api")
    return df.select(
        portal_id(F.trim("url")).alias("id"),
        F.trim("url").alias("uri"),
        F.when(filled(api), api).otherwise(F.trim("url")).alias("apiuri"),
        F.trim("software").alias("software"),
        country_code(F.col("country"), countries).alias("iso"),
        F.lit(True).alias("active"),
    ).where(F.col("id") != "")


def read_portals(spark: SparkSession, path: str, countries: dict[str, str] | None = None) -> DataFrame:
    """Registry as CSV without header: url, api, software, country."""
    rows = spark.read.schema("url string, api string, software string, country string").csv(path)
    return portal_rows(rows, countries).dropDuplicates(["id"])


def read_portal_urls(spark: SparkSession, path: str, software: str, country: str = "") -> DataFrame:
    """A plain list of portal urls of one software, the first column of each line."""
    rows = spark.read.schema("url string, api string").csv(path).where(filled(F.trim("url")))
    rows = rows.withColumns({"software": F.lit(software), "country": F.lit(country)})
    return portal_rows(rows).dropDuplicates(["id"])


def add_portal(portals: DataFrame, uri: str, api: str, software: str, iso: str) -> DataFrame:
    """The registry with one more portal, unless its id is there already."""
    new = portals.sparkSession.createDataFrame(
        [(uri, api, software, iso)], "url string, api string, software string, country string"
    )
    new = portal_rows(new).select(*portals.columns)
    return portals.unionByName(new.join(portals.select("id"), "id", "left_anti").select(*portals.columns))
