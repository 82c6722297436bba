"""Reports on top of the metrics: long form, improvement hints, contacts, organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catascope.operators.access import contact_values
from catascope.operators.quality import as_number

# Code, dimension and label of every metric; the question is our wording.
METRICS = [
    ("ExAc", "Existence", "Access", "Do the resources come with access information?"),
    ("ExCo", "Existence", "Contact", "Can the provider or publisher be contacted?"),
    ("ExDa", "Existence", "Date", "Are creation and modification dates of dataset and resources given?"),
    ("ExDi", "Existence", "Discovery", "Are there title, description and keywords to search by?"),
    ("ExPr", "Existence", "Preservation", "Are format, size and update frequency given?"),
    ("ExRi", "Existence", "Rights", "Is a license of dataset or resources given?"),
    ("ExSp", "Existence", "Spatial", "Is there spatial information?"),
    ("ExTe", "Existence", "Temporal", "Is there temporal information?"),
    ("CoAc", "Conformance", "AccessURL", "Is an access or download URL a valid URL?"),
    ("CoCE", "Conformance", "ContactEmail", "Is a contact value a valid e-mail address?"),
    ("CoCU", "Conformance", "ContactURL", "Is a contact value a valid URL?"),
    ("CoDa", "Conformance", "DateFormat", "Are the dates in a valid format?"),
    ("CoFo", "Conformance", "FileFormat", "Are formats and media types registered?"),
    ("CoLi", "Conformance", "License", "Is the license in the license registry?"),
    ("OpFo", "Open Data", "Format Openness", "Is the format an open one?"),
    ("OpLi", "Open Data", "License Openneness", "Is the license an open one?"),
    ("OpMa", "Open Data", "Format machine readability", "Can machines read the format?"),
]

# Code, type, explanation and hint of a failing metric, in our wording. ExSp has none.
HINTS = [
    ("ExDa", None, "Creation or modification dates of the dataset or its resources are empty", "Fill in the creation and modification dates"),
    ("ExRi", None, "There is no license information", "Add a license to the dataset"),
    ("ExPr", None, "Size, format, media type or update frequency of resources is missing", "Give format, media type, size and update frequency for each resource"),
    ("ExAc", None, "Resources have no access URL", "Give an access URL for each resource"),
    ("ExDi", None, "Title, description or keywords are empty", "Give title and description for dataset and resources"),
    ("ExTe", None, "Temporal information is missing", "Describe the time span the data covers"),
    ("ExCo", None, None, "Add contact information so that users can reach you"),
    ("CoCU", None, "No contact or publisher value is a valid URI", "Give a URI after RFC 3986 for contact or publisher"),
    ("CoCE", None, "No contact or publisher value is a valid e-mail address", "Give an address after RFC 5322 for contact or publisher"),
    ("CoDa", None, "Creation or modification dates are not valid dates", "Check the format of the date fields"),
    ("CoFo", None, "Formats or media types are not registered", "Use a registered format and media type"),
    ("CoLi", None, "The license is not in the license registry", "Use the id, URL or name of a registered license"),
    ("CoAc", None, "No access or download URL is a valid URI", "Give a URI after RFC 3986 as access or download URL"),
    ("OpFo", "warning", "Formats are not counted as open", "Use an open format, or ignore this warning"),
    ("OpMa", "warning", "Formats are not counted as machine readable", "Use a machine readable format, or ignore this warning"),
    ("OpLi", "warning", "The license is not counted as open", "Use an open license, or ignore this warning"),
]


def long_quality(portal_quality: DataFrame, keys: tuple[str, ...] = ("portalid", "snapshot")) -> DataFrame:
    """One row per metric with a value: dimension, label, mean, share of datasets judged."""
    rows = []
    for code, dimension, label, _ in METRICS:
        m = code.lower()
        rows.append(
            F.struct(
                F.lit(m).alias("metric"),
                F.lit(dimension).alias("dimension"),
                F.lit(label).alias("label"),
                F.col(m).cast("double").alias("value"),
                F.when(F.col("datasets") > 0, F.col(m + "N") / F.col("datasets")).otherwise(F.lit(0.0)).alias("perc"),
            )
        )
    return portal_quality.select(*keys, F.inline(F.array(*rows))).where(F.col("value").isNotNull())


def failing_metrics(quality: DataFrame, keys: tuple[str, ...] = ("md5",)) -> DataFrame:
    """One row per metric below 1 with hint texts; a metric without judgement fails too."""
    rows = []
    for code, kind, explanation, improvement in HINTS:
        m = code.lower()
        rows.append(
            F.struct(
                F.lit(code).alias("metric"),
                as_number(m).alias("value"),
                F.lit(explanation).cast("string").alias("explanation"),
                F.lit(improvement).alias("improvement"),
                F.lit(kind).cast("string").alias("type"),
            )
        )
    failing = F.filter(F.array(*rows), lambda r: F.coalesce(r["value"], F.lit(0.0)) < 1)
    return quality.select(*keys, F.inline(failing))


def with_contact(dcat: DataFrame) -> DataFrame:
    """The contact a report goes to: the second contact value of the document."""
    return dcat.withColumn("contact_to", F.get(contact_values(), F.lit(1)))


def organisation_contacts(datasets: DataFrame, contacts: DataFrame) -> DataFrame:
    """Distinct contacts of the organisations of a portal and snapshot.

    contacts has one row per md5 with contact_to.
    """
    pairs = datasets.select("portalid", "snapshot", "organisation", "md5").distinct()
    return (
        pairs.join(contacts.where(F.col("contact_to").isNotNull()).select("md5", "contact_to"), "md5")
        .select("portalid", "snapshot", "organisation", "contact_to")
        .distinct()
    )


def organisation_report(datasets: DataFrame, contacts: DataFrame, quality: DataFrame, resources: DataFrame, lookups: DataFrame) -> DataFrame:
    """Per organisation and contact: datasets, failing metrics and lookups by status.

    Statuses are counted once per content and week it was in use; only those counts meet the
    datasets.
    """
    by = ["portalid", "snapshot", "organisation", "contact_to"]
    per_content = failing_metrics(quality).groupBy("md5").agg(F.count(F.lit(1)).alias("failing"))
    owned = datasets.join(contacts.where(F.col("contact_to").isNotNull()).select("md5", "contact_to"), "md5")
    weights = owned.groupBy(*by, "md5").agg(F.count(F.lit(1)).alias("w"))
    status = (
        weights.select("md5", "snapshot").distinct()
        .join(resources.select("md5", "uri"), "md5")
        .join(lookups.select("uri", "snapshot", "status"), ["uri", "snapshot"])
        .groupBy("md5", "snapshot")
        .agg(
            F.count(F.lit(1)).alias("lookups"),
            F.count_if(F.col("status") == 200).alias("ok"),
            F.count_if(F.col("status") == 404).alias("missing"),
        )
    )
    w = F.col("w")
    rows = (
        weights.join(quality.select("md5"), "md5", "left_semi")
        .join(per_content, "md5", "left")
        .join(status, ["md5", "snapshot"], "left")
    )
    total = lambda c: F.coalesce(F.sum(F.col(c) * w), F.lit(0)).cast("bigint").alias(c)
    return rows.groupBy(*by).agg(
        F.sum("w").cast("bigint").alias("datasets"), total("failing"), total("lookups"), total("ok"), total("missing")
    )


def organisation_summary(datasets: DataFrame, contacts: DataFrame, resources: DataFrame, lookups: DataFrame) -> DataFrame:
    """Lookups of an organisation by status with every resource counted once."""
    by = ["portalid", "snapshot", "organisation"]
    owned = datasets.join(contacts.where(F.col("contact_to").isNotNull()).select("md5"), "md5")
    uris = (
        owned.select(*by, "md5").distinct()
        .join(resources.select("md5", "uri"), "md5")
        .select(*by, "uri")
        .distinct()
    )
    rows = uris.join(lookups.select("uri", "snapshot", "status"), ["uri", "snapshot"], "left")
    counted = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("totaluris"),
        F.count("status").alias("total"),
        F.count_if(F.col("status") == 200).alias("ok"),
        F.count_if(F.col("status") == 404).alias("missing"),
    )
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(F.lit(0.0))
    return counted.withColumns({"ok_share": share("ok"), "missing_share": share("missing")})

