"""The 17 metrics of a document, as column expressions over a DCAT row.

METRICS maps a name to a function without arguments that returns a Column; add an entry to
add a metric. Ratios are shares of filled values in an array, 0 for an empty one; a null
metric means there was nothing to judge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.functions.formats import MACHINE_READABLE, OPEN_FORMATS, common_registry
from catascope.functions.licenses import NOT_FOUND, map_license, map_licenses
from catascope.functions.text import filled, is_date, normalise_format
from catascope.functions.urls import email_valid, url_valid
from catascope.operators import access as a

PORTAL_METRICS = [
    "cocu", "coce", "coda", "cofo", "coli", "coac", "exda", "exri", "expr", "exac", "exdi", "exte",
    "exsp", "exco", "opfo", "opma", "opli",
]
BOOLEAN_METRICS = ["cocu", "coce", "coli", "coac", "exac", "exco", "opli"]


def share(values: Column, test: Callable[[Column], Column]) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.size(F.filter(values, test)) / n).otherwise(F.lit(0.0))


def ratio(values: Column) -> Column:
    return share(values, filled)


def any_filled(*arrays: Column) -> Column:
    return F.exists(F.concat(*arrays), filled)


def mean_ratio(*arrays: Column) -> Column:
    total = F.lit(0.0)
    for values in arrays:
        total = total + ratio(values)
    return total / len(arrays)


def any_conform(test: Callable[[Column], Column], *arrays: Column) -> Column:
    both = F.concat(*arrays)
    return F.when(F.size(both) > 0, F.exists(both, test))


def mean_conform(test: Callable[[Column], Column], *arrays: Column) -> Column:
    there = sum((F.size(v) > 0).cast("int") for v in arrays)
    good = sum(F.exists(v, test).cast("int") for v in arrays)
    return F.when(there > 0, good / there)


def share_in(values: Column, wanted: list[str]) -> Column:
    return F.when(F.size(values) > 0, share(values, lambda v: normalise_format(v).isin(wanted)))


_d, _r = a.dataset_values, F.col

EXISTENCE: dict[str, Callable[[], Column]] = {
    "exac": lambda: any_filled(_r("_access_url"), _r("_download_url")),
    "exco": lambda: any_filled(_d("contact"), _d("publisher")),
    "exdi": lambda: mean_ratio(_d("title"), _d("description"), _d("keywords"), _r("_title"), _r("_description")),
    "expr": lambda: mean_ratio(_d("frequency"), _r("_formats"), _r("_media_type"), _r("_byte_size")),
    "exda": lambda: mean_ratio(_d("issued"), _d("modified"), _r("_issued"), _r("_modified")),
    "exri": lambda: ratio(F.transform(_r("_licenses"), lambda n: n["ref"])),
    "exte": lambda: ratio(_d("temporal")),
    "exsp": lambda: ratio(_d("spatial")),
}
CONFORMANCE: dict[str, Callable[[], Column]] = {
    "coac": lambda: any_conform(url_valid, _r("_access_url"), _r("_download_url")),
    "coce": lambda: any_conform(email_valid, a.contact_values(), a.publisher_values()),
    "cocu": lambda: any_conform(url_valid, a.contact_values(), a.publisher_values()),
    "coda": lambda: mean_conform(is_date, _d("issued"), _d("modified"), _r("_issued"), _r("_modified")),
    "coli": lambda: F.when(F.size("_licenses") > 0, F.exists(_r("_conformance"), lambda c: c != NOT_FOUND)),
    "cofo": lambda: share_in(F.concat(_r("_formats"), _r("_media_type")), common_registry()),
}
OPENNESS: dict[str, Callable[[], Column]] = {
    "opfo": lambda: share_in(_r("_formats"), OPEN_FORMATS),
    "opma": lambda: share_in(_r("_formats"), MACHINE_READABLE),
    "opli": lambda: F.when(F.size("_licenses") > 0, F.get(_r("_conformance"), F.lit(0)) == "approved"),
}
METRICS: dict[str, Callable[[], Column]] = {**EXISTENCE, **CONFORMANCE, **OPENNESS}
EXTRA: dict[str, Callable[[], Column]] = {
    "identifier": lambda: ratio(_d("identifier")),
    "theme": lambda: ratio(_d("theme")),
    "language": lambda: ratio(_d("language")),
}


_BUILT: dict[str, dict[str, Column]] = {}


def _columns(dcat: DataFrame, name: str, build: Callable[[], Column]) -> Column:
    """A column without a DataFrame of its own, built once per application."""
    app = dcat.sparkSession.sparkContext.applicationId
    if app not in _BUILT:
        _BUILT.clear()
        _BUILT[app] = {}
    made = _BUILT[app]
    if name not in made:
        made[name] = build()
    return made[name]


def _mapped_licenses() -> Column:
    return F.transform("_licenses", lambda n: map_license(n["label"], n["identifier"], n["ref"])["conformance"])


def _prepared(dcat: DataFrame) -> DataFrame:
    """Distribution values are pulled out once; the metrics share them."""
    plain = ["access_url", "download_url", "title", "description", "media_type", "byte_size", "issued", "modified"]
    parts: dict[str, Callable[[], Column]] = {"_" + n: (lambda n=n: a.distribution_values(n)) for n in plain}
    parts |= {"_formats": a.distribution_formats, "_licenses": a.license_nodes}
    rows = dcat.withColumns({n: _columns(dcat, n, build) for n, build in parts.items()})
    return rows.withColumn("_conformance", _columns(dcat, "_conformance", _mapped_licenses))


def quality(dcat: DataFrame, metrics: list[str] | None = None, keys: list[str] | None = None, extra: bool = False) -> DataFrame:
    """Metric columns per document: a projection without shuffle or Python."""
    chosen = {**METRICS, **EXTRA} if extra else METRICS
    names = [m.lower() for m in metrics] if metrics else list(chosen)
    rows = _prepared(dcat)
    return rows.select(*(keys or ["md5"]), *[_columns(dcat, "metric " + n, chosen[n]).alias(n) for n in names])


def registered_format_share(dcat: DataFrame, registry: DataFrame) -> DataFrame:
    """Metric cofo against a media type registry table (column token) of any size."""
    # the outer form: Spark would repeat the whole mapping in a filter below the plain one
    values = _prepared(dcat).select(
        "md5", F.explode_outer(F.concat("_formats", "_media_type")).alias("v")
    ).where(F.col("v").isNotNull())
    counted = values.groupBy("md5", normalise_format(F.col("v")).alias("token")).count()
    known = registry.select(F.col("token").alias("known")).distinct()
    hits = counted.join(known, F.col("token") == F.col("known"), "left")
    return hits.groupBy("md5").agg(
        (F.sum(F.when(F.col("known").isNotNull(), F.col("count")).otherwise(0)) / F.sum("count")).alias("cofo")
    )


def license_conformance(dcat: DataFrame, registry: DataFrame) -> DataFrame:
    """Metrics coli and opli against a license registry table of any size."""
    nodes = _prepared(dcat).select("md5", F.posexplode_outer("_licenses").alias("pos", "n")).where(F.col("n").isNotNull())
    flat = nodes.select("md5", "pos", F.col("n.label").alias("title"), F.col("n.identifier").alias("lid"), F.col("n.ref").alias("url"))
    mapped = map_licenses(flat, registry, "title", "lid", "url")
    return mapped.groupBy("md5").agg(
        F.bool_or(F.col("conformance") != NOT_FOUND).alias("coli"),
        (F.min_by("conformance", "pos") == "approved").alias("opli"),
    )


def element_counts(dcat: DataFrame, values: Column) -> DataFrame:
    """Number of occurrences of every distinct value."""
    each = dcat.select(F.explode_outer(values).alias("value")).where(F.col("value").isNotNull())
    return each.groupBy("value").count()


def as_number(metric: str) -> Column:
    c = F.col(metric)
    return c.cast("int").cast("double") if metric in BOOLEAN_METRICS else c


def portal_quality(datasets: DataFrame, scores: DataFrame, by: tuple[str, ...] = ("portalid", "snapshot")) -> DataFrame:
    """Mean (2 decimals, half to even) and number of values of every metric per portal and snapshot.

    Occurrences are counted per content before the join, so a content shared by many
    datasets goes through the shuffle once per group.
    """
    weights = datasets.groupBy(*by, "md5").agg(F.count(F.lit(1)).alias("w"))
    joined = weights.join(scores, "md5")
    aggs = []
    for m in PORTAL_METRICS:
        v = as_number(m)
        n = F.sum(F.when(v.isNotNull(), F.col("w")).otherwise(0))
        mean = F.when(n > 0, F.sum(v * F.col("w")) / n)
        aggs.append((F.rint(mean * 100) / 100).alias(m))
        aggs.append(n.cast("int").alias(m + "N"))
    return joined.groupBy(*by).agg(*aggs, F.sum("w").cast("int").alias("datasets"))
