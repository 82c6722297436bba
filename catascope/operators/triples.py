"""DCAT rows and quality rows as triples (s, p, o, kind of o, type of o)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.functions.ratios import angle, node_id
from catascope.functions.snapshot import monday_of, sunday_of
from catascope.functions.urls import uri_valid
from catascope.operators.mapping import DCAT, DCT, FOAF, RDF, RDFS, SCHEMA, SKOS, VCARD

ADMS, OWL = "http://www.w3.org/ns/adms#", "http://www.w3.org/2002/07/owl#"
LOCN = "http://www.w3.org/ns/locn#"
DQV, PROV = "http://www.w3.org/ns/dqv#", "http://www.w3.org/ns/prov#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = RDF + "type"
OWN = "urn:catascope:"

TRIPLE = "array<struct<s:string,p:string,o:string,o_kind:string,o_type:string>>"

_PLAIN = {
    "title": DCT + "title", "description": DCT + "description", "landing_page": DCAT + "landingPage",
    "identifier": DCT + "identifier", "version": OWL + "versionInfo",
    "alternate_identifier": ADMS + "identifier", "version_notes": ADMS + "versionNotes",
    "frequency": DCT + "accrualPeriodicity", "repository_name": OWN + "repositoryName",
    "category": OWN + "category", "keywords": DCAT + "keyword", "language": DCT + "language",
    "theme": DCAT + "theme", "conforms_to": DCAT + "conformsTo",
}


def _kind(node: Column) -> Column:
    return F.when(node.startswith("_:"), "bnode").otherwise("uri")


def _t(s: Column, p: str, o: Column, kind: str | Column = "literal", o_type: str | None = None) -> Column:
    return F.struct(
        s.alias("s"),
        F.lit(p).alias("p"),
        o.alias("o"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("o_kind"),
        F.lit(o_type).cast("string").alias("o_type"),
    )


def _link(s: Column, p: str, o: Column) -> Column:
    return _t(s, p, o, _kind(o))


def _each(s: Column, p: str, values: Column, o_type: str | None = None, maybe_uri: bool = False) -> Column:
    kind = (lambda v: F.when(uri_valid(v), "uri").otherwise("literal")) if maybe_uri else (lambda v: "literal")
    return F.transform(values, lambda v: _t(s, p, v, kind(v), o_type))


def _nodes(s: Column, p: str, nodes: Column, cls: str, props: dict[str, str]) -> Column:
    def build(n: Column) -> Column:
        rows = [_link(s, p, n["ref"]), _t(n["ref"], TYPE, F.lit(cls), "uri")]
        rows += [_t(n["ref"], pred, n[name]) for name, pred in props.items()]
        return F.array(*rows)

    return F.flatten(F.transform(nodes, build))


def _dates(s: Column, p: str, values: Column) -> Column:
    return F.transform(
        values,
        lambda v: F.struct(
            s.alias("s"), F.lit(p).alias("p"), v.alias("o"), F.lit("literal").alias("o_kind"),
            F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.lit(XSD + "dateTime")).alias("o_type"),
        ),
    )


def dcat_triples(dcat: DataFrame, keys: list[str] | None = None, portal_uri: str | None = None) -> DataFrame:
    """All triples of the documents; portal_uri names a column to link the portal from."""
    s = F.col("uri")
    groups = [F.array(_t(s, TYPE, F.lit(DCAT + "Dataset"), "uri"))]
    if portal_uri:
        groups.append(F.array(_t(F.col(portal_uri), DCAT + "dataset", s, "uri")))
    groups += [_each(s, p, F.col(name)) for name, p in _PLAIN.items()]
    groups.append(_each(s, RDFS + "seeAlso", F.col("see_also"), maybe_uri=True))
    groups += [_dates(s, DCT + n, F.col(n)) for n in ("issued", "modified")]
    groups.append(_nodes(s, DCAT + "contactPoint", F.col("contact"), VCARD + "Organization", {"fn": VCARD + "fn", "email": VCARD + "hasEmail"}))
    groups.append(
        _nodes(s, DCT + "publisher", F.col("publisher"), FOAF + "Organization", {
            "identifier": DCT + "identifier", "name": FOAF + "name", "mbox": FOAF + "mbox",
            "homepage": FOAF + "homepage", "type": DCT + "type",
        })
    )
    groups.append(_nodes(s, DCT + "temporal", F.col("temporal"), DCT + "PeriodOfTime", {"start": SCHEMA + "startDate", "end": SCHEMA + "endDate"}))
    groups.append(_nodes(s, DCT + "spatial", F.col("spatial"), DCT + "Location", {"label": SKOS + "prefLabel", "geometry": LOCN + "geometry"}))

    def dist(d: Column) -> Column:
        r = d["ref"]
        out = [F.array(_link(s, DCAT + "distribution", r), _t(r, TYPE, F.lit(DCAT + "Distribution"), "uri"))]
        for name, p in [
            ("title", DCT + "title"), ("description", DCT + "description"), ("status", ADMS + "status"),
            ("rights", DCT + "rights"), ("media_type", DCAT + "mediaType"),
        ]:
            out.append(_each(r, p, d[name]))
        out.append(_each(r, DCAT + "byteSize", d["byte_size"], XSD + "decimal"))
        out += [_each(r, DCAT + p, d[n], maybe_uri=True) for n, p in (("access_url", "accessURL"), ("download_url", "downloadURL"))]
        out += [_dates(r, DCT + n, d[n]) for n in ("issued", "modified")]
        out.append(_nodes(r, DCT + "license", d["license"], DCT + "LicenseDocument", {"label": RDFS + "label", "identifier": DCT + "identifier", "comment": RDFS + "comment"}))
        out.append(_nodes(r, DCT + "format", d["format"], DCT + "MediaTypeOrExtent", {"label": RDFS + "label", "value": RDF + "value"}))
        return F.concat(*[o.cast(TRIPLE) for o in out])

    groups.append(F.flatten(F.transform(F.col("distributions"), dist)))
    every = F.concat(*[g.cast(TRIPLE) for g in groups])
    rows = F.array_distinct(F.filter(every, lambda t: t["o"].isNotNull() & t["s"].isNotNull()))
    return dcat.select(*(keys or []), F.inline_outer(rows)).where(F.col("s").isNotNull())


def _term(kind: Column, value: Column, o_type: Column) -> Column:
    quoted = F.concat(F.lit('"'), _escape(value), F.lit('"'))
    return (
        F.when(kind == "uri", F.concat(F.lit("<"), value, F.lit(">")))
        .when(kind == "bnode", value)
        .when(o_type.isNotNull(), F.concat(quoted, F.lit("^^<"), o_type, F.lit(">")))
        .otherwise(quoted)
    )


def _escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def n_triples(triples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One line of N-Triples per row."""
    subject = _term(_kind(F.col("s")), F.col("s"), F.lit(None).cast("string"))
    line = F.concat_ws(" ", subject, F.concat(F.lit("<"), F.col("p"), F.lit(">")), _term(F.col("o_kind"), F.col("o"), F.col("o_type")), F.lit("."))
    return triples.select(*(keys or []), line.alias("value"))


def json_ld_nodes(triples: DataFrame, keys: list[str]) -> DataFrame:
    """JSON-LD text of the nodes: one row per subject with its properties.

    A node is one document's share of a subject, so its size is bounded by the document. Triples are
    dealt by their node once, for both steps.
    """
    value = F.when(
        F.col("o_kind") == "literal", F.to_json(F.struct(F.col("o").alias("@value"), F.col("o_type").alias("@type")))
    ).otherwise(F.to_json(F.struct(F.col("o").alias("@id"))))
    props = triples.repartition(*keys, "s").groupBy(*keys, "s", "p").agg(
        F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(value)), ","), F.lit("]")).alias("v")
    )
    pair = F.concat(F.lit('"'), F.col("p"), F.lit('":'), F.col("v"))
    return props.groupBy(*keys, "s").agg(
        F.concat(
            F.lit('{"@id":"'), F.first("s"), F.lit('",'), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")
        ).alias("node")
    )


# Metric column, vocabulary name, dimension, data type of the exported measures.
MEASURES = [
    ("exda", "Date", "Existence"),
    ("exri", "Rights", "Existence"),
    ("expr", "Preservation", "Existence"),
    ("exac", "Access", "Existence"),
    ("exdi", "Discovery", "Existence"),
    ("exco", "Contact", "Existence"),
    ("cocu", "ContactURL", "Conformance"),
    ("coda", "DateFormat", "Conformance"),
    ("cofo", "FileFormat", "Conformance"),
    ("coce", "ContactEmail", "Conformance"),
    ("coli", "License", "Conformance"),
    ("coac", "AccessURL", "Conformance"),
    ("opfo", "OpenFormat", "OpenData"),
    ("opma", "MachineRead", "OpenData"),
    ("opli", "OpenLicense", "OpenData"),
]


def measure_rows(quality: DataFrame, dataset: str = "uri", snapshot: str = "snapshot", base: str = OWN + "quality#") -> DataFrame:
    """One row per dataset and exported metric: measure node, metric, value."""
    pairs = [
        F.struct(F.lit(base + name).alias("metric"), F.col(metric).cast("string").alias("value"))
        for metric, name, _ in MEASURES
    ]
    rows = quality.select(F.col(dataset).alias("dataset"), F.col(snapshot).alias("snapshot"), F.inline(F.array(*pairs)))
    return rows.withColumn(
        "measure",
        node_id(angle(F.col("dataset")), F.col("snapshot"), angle(F.col("metric")), F.coalesce("value", F.lit("None"))),
    )


def measure_triples(measures: DataFrame, activity: str | None = None) -> DataFrame:
    m, d = F.col("measure"), F.col("dataset")
    rows = [
        _t(m, DQV + "isMeasurementOf", F.col("metric"), "uri"),
        _t(m, DQV + "value", F.coalesce("value", F.lit("None"))),
        _t(d, DQV + "hasQualityMeasurement", m, "bnode"),
        _t(m, TYPE, F.lit(DQV + "QualityMeasurement"), "uri"),
        _t(m, DQV + "computedOn", d, "uri"),
    ]
    if activity:
        a = F.col(activity)
        rows += [
            _t(m, TYPE, F.lit(PROV + "Entity"), "uri"),
            _t(m, PROV + "wasDerivedFrom", d, "uri"),
            _t(m, PROV + "wasGeneratedBy", a, "uri"),
            _t(a, PROV + "generated", m, "bnode"),
        ]
    return measures.select(F.inline(F.array(*rows).cast(TRIPLE)))


def vocabulary(spark, base: str = OWN + "quality#") -> DataFrame:
    """The dimensions and metrics the measures refer to; a constant table."""
    from catascope.operators.reports import METRICS

    text = {code.lower(): (label, question) for code, _, label, question in METRICS}
    rows = []
    for dim in ("Existence", "Conformance", "OpenData"):
        rows += [(base + dim, TYPE, DQV + "Dimension", "uri", None), (base + dim, SKOS + "prefLabel", dim, "literal", None)]
    for metric, name, dim in MEASURES:
        node, (label, question) = base + name, text[metric]
        rows += [
            (node, TYPE, DQV + "Metric", "uri", None),
            (node, SKOS + "prefLabel", label, "literal", None),
            (node, SKOS + "definition", question, "literal", None),
            (node, DQV + "expectedDataType", XSD + "double", "uri", None),
            (node, DQV + "inDimension", base + dim, "uri", None),
        ]
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_type string")


def harvest_provenance(runs: DataFrame, base: str = OWN + "portal/", agent: str = OWN + "agent") -> DataFrame:
    """Activity of every harvest run with its times."""
    a = F.concat(F.lit(base), F.col("portalid"), F.lit("/"), F.col("snapshot").cast("string"))
    rows = [
        _t(a, TYPE, F.lit(PROV + "Activity"), "uri"),
        _t(a, PROV + "startedAtTime", F.col("start_ts").cast("string")),
        _t(a, PROV + "endedAtTime", F.col("end_ts").cast("string")),
        _t(a, PROV + "wasAssociatedWith", F.lit(agent), "uri"),
    ]
    every = F.filter(F.array(*rows).cast(TRIPLE), lambda t: t["o"].isNotNull())
    return runs.select("portalid", "snapshot", F.inline(every))


def week_provenance(snapshots: DataFrame, base: str = OWN + "csvw/", agent: str = OWN + "agent") -> DataFrame:
    """Activity of a weekly job: from Monday to Sunday of its snapshot."""
    a = F.concat(F.lit(base), F.col("snapshot").cast("string"))
    rows = [
        _t(a, TYPE, F.lit(PROV + "Activity"), "uri"),
        _t(a, PROV + "startedAtTime", monday_of(F.col("snapshot")).cast("string")),
        _t(a, PROV + "endedAtTime", sunday_of(F.col("snapshot")).cast("string")),
        _t(a, PROV + "wasAssociatedWith", F.lit(agent), "uri"),
    ]
    return snapshots.select("snapshot", F.inline(F.array(*rows).cast(TRIPLE)))


