"""Raw metadata documents of five portal softwares to one DCAT-shaped table.

A mapping is a function DataFrame -> DataFrame registered by software name. Its input has
`raw` (JSON text), `apiuri` and any key columns; its output keeps the keys and adds `uri`
and the columns of DCAT_SCHEMA. Everything is a projection, nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.functions import documents as doc
from catascope.functions.ratios import angle, node_id
from catascope.functions.text import filled, iso_or_text, list_items
from catascope.functions.urls import domain

DATASET_LISTS = [
    "title", "description", "landing_page", "identifier", "version", "alternate_identifier",
    "version_notes", "frequency", "repository_name", "category", "keywords", "issued", "modified",
    "language", "theme", "conforms_to", "see_also",
]
CONTACT = "array<struct<ref:string,fn:string,email:string>>"
PUBLISHER = "array<struct<ref:string,identifier:string,name:string,mbox:string,homepage:string,type:string>>"
TEMPORAL = "array<struct<ref:string,start:string,end:string>>"
SPATIAL = "array<struct<ref:string,label:string,geometry:string>>"
LICENSE = "array<struct<ref:string,label:string,identifier:string,comment:string>>"
FORMAT = "array<struct<ref:string,label:string,value:string>>"
DISTRIBUTIONS = (
    "array<struct<ref:string,title:array<string>,description:array<string>,status:array<string>,"
    f"rights:array<string>,license:{LICENSE},access_url:array<string>,download_url:array<string>,"
    f"media_type:array<string>,format:{FORMAT},issued:array<string>,modified:array<string>,"
    "byte_size:array<string>>>"
)
NODES = {
    "contact": CONTACT,
    "publisher": PUBLISHER,
    "temporal": TEMPORAL,
    "spatial": SPATIAL,
    "distributions": DISTRIBUTIONS,
}
DCAT_SCHEMA = {**{name: "array<string>" for name in DATASET_LISTS}, **NODES}

DCT = "http://purl.org/dc/terms/"
DCAT = "http://www.w3.org/ns/dcat#"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _some(c: Column) -> Column:
    return F.when(filled(c), c)


def _first(*cs: Column) -> Column:
    return F.coalesce(*[_some(c) for c in cs])


def _only(test: Column, row: Column, kind: str) -> Column:
    """One node when the test holds, no node otherwise."""
    return F.when(test, F.array(row).cast(kind)).otherwise(_empty(kind))


def _node(kind: str, **fields: Column) -> Column:
    """A struct with the fields of a node type in order, the missing ones null."""
    names = [f.split(":")[0] for f in kind.removeprefix("array<struct<").removesuffix(">>").split(",")]
    return F.struct(*[fields.get(n, F.lit(None).cast("string")).alias(n) for n in names])


def _distribution(**fields: Column) -> Column:
    lists = ["title", "description", "status", "rights", "access_url", "download_url", "media_type", "issued", "modified", "byte_size"]
    base: dict[str, Column] = {name: _empty("array<string>") for name in lists}
    base |= {"license": _empty(LICENSE), "format": _empty(FORMAT)}
    base |= fields
    order = [
        "ref", "title", "description", "status", "rights", "license", "access_url", "download_url",
        "media_type", "format", "issued", "modified", "byte_size",
    ]
    return F.struct(*[base[n].alias(n) for n in order])


def _size(text: Column) -> Column:
    """Byte size as a decimal text, or the text when it is no number."""
    return doc.one(F.coalesce(text.try_cast("double").cast("string"), text))


def _finish(**columns: Column) -> list[Column]:
    out = [columns["uri"].alias("uri")]
    for name, kind in DCAT_SCHEMA.items():
        out.append(columns.get(name, _empty(kind)).cast(kind).alias(name))
    return out


Stages = tuple[list[dict[str, Column]], list[Column]]


def _mapping(build: Callable[[], Stages]) -> Callable[[DataFrame], DataFrame]:
    """A mapping from its stages of helper columns and its final columns.

    The columns name their inputs and belong to no DataFrame, so they are built once per
    application and used for every batch of records.
    """
    built: dict[str, Stages] = {}

    def apply(df: DataFrame) -> DataFrame:
        app = df.sparkSession.sparkContext.applicationId
        if app not in built:
            built.clear()
            built[app] = build()
        stages, final = built[app]
        d = df
        for stage in stages:
            d = d.withColumns(stage)
        return d.select(*df.columns, *final)

    apply.__name__, apply.__doc__ = build.__name__.lstrip("_"), build.__doc__
    return apply


def _parsed() -> dict[str, Column]:
    return {"_doc": F.try_parse_json("raw"), "_base": F.rtrim(F.col("apiuri"), F.lit("/"))}


CKAN_FIELDS = [
    "title", "notes", "url", "identifier", "guid", "id", "version", "alternate_identifier",
    "version_notes", "frequency", "frequency-of-update", "name", "categorization", "issued",
    "metadata_created", "modified", "metadata_modified", "language", "theme", "conforms_to",
    "dcat_version", "contact_uri", "contact_name", "contact_email", "maintainer", "maintainer_email", "author",
    "author_email", "contact-email", "publisher_uri", "publisher_name", "publisher_email",
    "publisher_url", "publisher_type", "temporal_start", "temporal_end", "spatial_uri",
    "spatial_text", "spatial", "license_id", "license_url", "license_title", "uri",
]


def _ckan_resource(r: Column) -> Column:
    """Fields of a resource, the first filled one of each group."""
    at = lambda *ks: _first(*[doc.get(r, k) for k in ks])
    plain = ["uri", "id", "package_id", "name", "description", "status", "rights", "license", "format", "mimetype", "url", "download_url", "size"]
    return F.struct(
        *[at(k).alias(k) for k in plain],
        at("issued", "created", "metadata-date").alias("issued"),
        at("modified", "last_modified").alias("modified"),
        F.concat(F.lit("_:"), F.sha1(F.to_json(r))).alias("hash"),
    )


@_mapping
def ckan() -> Stages:
    """Records of CKAN portals."""
    fields = {
        **{"f_" + k: doc.field(F.col("_doc"), F.col("_extras"), k) for k in CKAN_FIELDS},
        "f_org_title": doc.get(F.col("_doc"), "organization.title"),
        "f_org_id": doc.get(F.col("_doc"), "organization.id"),
    }
    f = lambda k: F.col(f"`f_{k}`")
    first = {
        "title": ("title",), "description": ("notes",), "landing_page": ("url",), "identifier": ("identifier", "guid", "id"),
        "version": ("version", "dcat_version"), "alternate_identifier": ("alternate_identifier",), "version_notes": ("version_notes",),
        "frequency": ("frequency", "frequency-of-update"), "repository_name": ("name", "id"), "category": ("categorization",),
        "issued": ("issued", "metadata_created"), "modified": ("modified", "metadata_modified"),
        "fn": ("contact_name", "maintainer", "author"), "email": ("contact_email", "maintainer_email", "author_email", "contact-email"),
    }
    own = F.concat(F.col("_base"), F.lit("/dataset/"), _first(f("id"), F.md5(F.to_json("_doc"))))
    chosen = {
        **{"v_" + name: _first(*[f(k) for k in ks]) for name, ks in first.items()},
        "_uri": _first(f("uri"), own),
        "_name": _first(f("publisher_name"), f("org_title")),
        "_res": F.transform(doc.elements(F.col("_doc"), "resources"), _ckan_resource),
    }
    value = lambda name: doc.unwrap_label(F.col("v_" + name))
    values = lambda name: doc.one(value(name))
    dates = lambda name: doc.one(iso_or_text(F.col("v_" + name)))
    uri = angle(F.col("_uri"))

    contact_any = reduce(
        lambda a, b: a | b,
        [filled(f(k)) for k in ("contact_uri", "contact_name", "contact_email", "maintainer", "maintainer_email", "author", "author_email")],
    )
    contact = _node(
        CONTACT,
        ref=F.coalesce(_some(f("contact_uri")), node_id(uri, F.lit("contactPoint"))),
        fn=value("fn"),
        email=value("email"),
    )
    name = F.col("_name")
    org_uri = F.concat(F.col("_base"), F.lit("/organization/"), f("org_id"))
    publisher = _node(
        PUBLISHER,
        ref=F.coalesce(_some(f("publisher_uri")), org_uri, node_id(uri, F.lit("publisher"), name)),
        name=name,
        mbox=_some(f("publisher_email")),
        homepage=_some(f("publisher_url")),
        type=_some(f("publisher_type")),
    )
    publisher_any = filled(f("publisher_uri")) | filled(name) | f("org_id").isNotNull()
    temporal = _node(
        TEMPORAL,
        ref=node_id(uri, F.lit("temporal"), f("temporal_start"), f("temporal_end")),
        start=iso_or_text(_some(f("temporal_start"))),
        end=iso_or_text(_some(f("temporal_end"))),
    )
    spatial = _node(
        SPATIAL,
        ref=F.coalesce(_some(f("spatial_uri")), node_id(uri, F.lit("spatial"), f("spatial_text"), f("spatial"))),
        label=_some(f("spatial_text")),
        geometry=_some(f("spatial")),
    )
    is_link = domain(f("license_url")) != ""
    license_any = filled(f("license_id")) | filled(f("license_url")) | filled(f("license_title"))
    licence = _node(
        LICENSE,
        ref=F.coalesce(
            F.when(is_link, f("license_url")),
            node_id(uri, F.lit("license"), f("license_id"), f("license_url"), f("license_title")),
        ),
        label=_some(f("license_title")),
        identifier=_some(f("license_id")),
        comment=F.when(~is_link, _some(f("license_url"))),
    )
    nodes = {"_license": _only(license_any, licence, LICENSE)}

    def resource(r: Column) -> Column:
        ref = _first(
            r["uri"],
            F.concat(F.col("_base"), F.lit("/dataset/"), F.coalesce(_some(f("id")), r["package_id"]), F.lit("/resource/"), r["id"]),
            r["hash"],
        )
        typed = F.coalesce(r["format"].contains("/"), F.lit(False))
        extra = _only(r["license"].isNotNull(), _node(LICENSE, ref=F.trim(r["license"])), LICENSE)
        fnode = _node(FORMAT, ref=node_id(uri, F.lit("format"), r["format"]), label=F.trim(r["format"]), value=r["mimetype"])
        return _distribution(
            ref=ref,
            title=doc.one(doc.unwrap_label(r["name"])),
            description=doc.one(doc.unwrap_label(r["description"])),
            status=doc.one(doc.unwrap_label(r["status"])),
            rights=doc.one(doc.unwrap_label(r["rights"])),
            license=F.concat(F.col("_license"), extra),
            access_url=doc.one(F.when(r["download_url"].isNull() | (r["url"] != r["download_url"]), r["url"])),
            download_url=doc.one(r["download_url"]),
            media_type=doc.one(F.when(typed, r["format"]).otherwise(r["mimetype"])),
            format=_only(r["format"].isNotNull() & ~typed, fnode, FORMAT),
            issued=doc.one(iso_or_text(r["issued"])),
            modified=doc.one(iso_or_text(r["modified"])),
            byte_size=_size(r["size"]),
        )

    tags = F.transform(
        doc.elements(F.col("_doc"), "tags"),
        lambda t: F.trim(F.coalesce(doc.get(t, "name"), F.try_variant_get(t, "$", "string"))),
    )
    extras = {"_extras": doc.extras_map(F.col("_doc"))}
    return [_parsed(), extras, fields, chosen, nodes], _finish(
        uri=F.col("_uri"),
        **{
            n: values(n)
            for n in ("title", "description", "landing_page", "identifier", "version", "alternate_identifier", "version_notes", "frequency", "repository_name", "category")
        },
        keywords=tags,
        issued=dates("issued"),
        modified=dates("modified"),
        language=list_items(f("language")),
        theme=list_items(f("theme")),
        conforms_to=list_items(f("conforms_to")),
        contact=_only(contact_any, contact, CONTACT),
        publisher=_only(publisher_any, publisher, PUBLISHER),
        temporal=_only(filled(f("temporal_start")) | filled(f("temporal_end")), temporal, TEMPORAL),
        spatial=_only(filled(f("spatial_uri")) | filled(f("spatial_text")) | filled(f("spatial")), spatial, SPATIAL),
        distributions=F.transform("_res", resource),
    )


_LINK = "struct<_resource:string,_VALUE:string>"
_RDF_DATASET = (
    "struct<title:array<string>,description:array<string>,identifier:array<string>,"
    "keyword:array<string>,theme:array<string>,language:array<string>,accrualPeriodicity:array<string>,"
    f"landingPage:array<{_LINK}>,issued:array<string>,modified:array<string>,created:array<string>,"
    "last_modified:array<string>,"
    f"distribution:array<struct<Download:struct<_about:string,title:array<string>,"
    f"accessURL:array<{_LINK}>,downloadURL:array<{_LINK}>,"
    "format:array<struct<Description:struct<label:string,value:string>>>>>>>"
)


@_mapping
def socrata() -> Stages:
    """Views of Socrata portals with their RDF/XML text."""
    view = {
        "_dcat": doc.get(F.col("_doc"), "dcat"),
        "_id": doc.get(F.col("_doc"), "view.id"),
        "_owner": _some(doc.get(F.col("_doc"), "view.owner.displayName")),
        "_author": _some(doc.get(F.col("_doc"), "view.tableAuthor.displayName")),
    }
    rdf = F.from_xml(
        F.col("_dcat"), f"Dataset {_RDF_DATASET}", {"ignoreNamespace": "true", "attributePrefix": "_"}
    )
    graph = {
        "_ds": F.when(filled(F.col("_dcat")), rdf).getField("Dataset"),
        "_uri": F.concat(F.col("_base"), F.lit("/dataset/"), F.col("_id")),
    }
    uri, there = angle(F.col("_uri")), F.col("_ds").isNotNull()
    got = lambda name: F.transform(F.coalesce(F.col(f"_ds.{name}"), _empty("array<string>")), lambda x: F.trim(x))
    links = lambda c: F.transform(
        F.coalesce(c, _empty(f"array<{_LINK}>")), lambda x: F.trim(F.coalesce(x["_resource"], x["_VALUE"]))
    )
    as_dates = lambda c: F.transform(c, iso_or_text)

    def download(x: Column) -> Column:
        n = x["Download"]
        formats = F.transform(
            F.coalesce(n["format"], _empty("array<struct<Description:struct<label:string,value:string>>>")),
            lambda y: y["Description"],
        )
        return _distribution(
            ref=node_id(uri, n["_about"], F.to_json(n)),
            title=F.coalesce(n["title"], _empty("array<string>")),
            access_url=links(n["accessURL"]),
            download_url=links(n["downloadURL"]),
            media_type=F.array_compact(F.transform(formats, lambda y: y["value"])),
            format=F.transform(
                F.filter(formats, lambda y: y["label"].isNotNull()),
                lambda y: _node(FORMAT, ref=y["label"], label=y["label"], value=y["value"]),
            ),
        )

    distribution = F.coalesce(
        F.col("_ds.distribution"),
        F.array().cast(_RDF_DATASET.split("distribution:", 1)[1].rsplit(">", 1)[0]),
    )
    return [_parsed(), view, graph], _finish(
        uri=F.col("_uri"),
        title=got("title"),
        description=got("description"),
        identifier=got("identifier"),
        keywords=got("keyword"),
        theme=got("theme"),
        language=got("language"),
        frequency=got("accrualPeriodicity"),
        landing_page=links(F.col("_ds.landingPage")),
        issued=as_dates(F.concat(got("issued"), got("created"))),
        modified=as_dates(F.concat(got("modified"), got("last_modified"))),
        publisher=_only(
            there & F.col("_owner").isNotNull(),
            _node(PUBLISHER, ref=node_id(uri, F.lit("publisher"), F.col("_owner")), name=F.col("_owner")),
            PUBLISHER,
        ),
        contact=_only(
            there & F.col("_author").isNotNull(),
            _node(CONTACT, ref=node_id(uri, F.lit("fn"), F.col("_author")), fn=F.col("_author")),
            CONTACT,
        ),
        distributions=F.transform(distribution, download),
    )


# The files a table of records can be exported as.
TABLE_EXPORTS = [("csv", "text/csv"), ("json", "application/json"), ("xls", "application/vnd.ms-excel")]
GEO_EXPORTS = [("geojson", "application/vnd.geo+json"), ("kml", "application/vnd.google-earth.kml+xml")]


@_mapping
def opendatasoft() -> Stages:
    """Datasets of OpenDataSoft portals: exports of the records and attachments."""
    whole = F.col("_doc")
    metas = ["title", "description", "language", "theme", "keyword", "publisher", "modified", "metadata_processed", "metadata_modified", "references", "license", "data_processed"]
    m = lambda k: F.col("m_" + k)
    given = {
        "_id": doc.get(whole, "datasetid"),
        **{"m_" + n: _some(doc.get(whole, f"metas.{n}")) for n in metas},
        "_records": F.coalesce(doc.get(whole, "has_records", "boolean"), F.lit(False)),
        "_geo": F.coalesce(F.array_contains(doc.get(whole, "features", "array<string>"), "geo"), F.lit(False)),
    }
    named = {"_uri": F.concat(F.col("_base"), F.lit("/explore/dataset/"), F.col("_id"))}
    uri = angle(F.col("_uri"))
    lic = lambda ref: _only(
        m("license").isNotNull(),
        _node(LICENSE, ref=node_id(ref, m("license")), label=m("license")),
        LICENSE,
    )

    def exported(fmt: str, mime: str) -> Column:
        url = F.concat(F.col("_base"), F.lit("/api/records/1.0/download?dataset="), F.col("_id"), F.lit("&format=" + fmt))
        ref = node_id(uri, url)
        return _distribution(
            ref=ref,
            access_url=F.array(url),
            license=lic(ref),
            format=F.array(_node(FORMAT, ref=node_id(ref, F.lit(fmt), F.lit(mime)), label=F.lit(fmt), value=F.lit(mime))),
            media_type=F.array(F.lit(mime)),
            modified=doc.one(iso_or_text(m("data_processed"))),
        )

    def attached(a: Column) -> Column:
        ref = node_id(uri, F.to_json(a))
        url = F.concat(F.col("_base"), F.lit("/api/datasets/1.0/"), F.col("_id"), F.lit("/attachments/"), doc.get(a, "id"))
        fmt = _some(doc.get(a, "format"))
        return _distribution(
            ref=ref,
            title=doc.one(doc.value(a, None, "title")),
            license=lic(ref),
            access_url=doc.one(url),
            media_type=doc.one(doc.get(a, "mimetype")),
            format=_only(fmt.isNotNull(), _node(FORMAT, ref=fmt, label=fmt), FORMAT),
        )

    tables = F.array(*[exported(*x) for x in TABLE_EXPORTS])
    maps = F.array(*[exported(*x) for x in GEO_EXPORTS])
    none = F.array().cast(DISTRIBUTIONS)
    return [_parsed(), given, named], _finish(
        uri=F.col("_uri"),
        identifier=doc.one(F.col("_id")),
        title=doc.one(doc.unwrap_label(m("title"))),
        description=doc.one(doc.unwrap_label(m("description"))),
        language=list_items(m("language")),
        theme=list_items(m("theme")),
        keywords=list_items(m("keyword")),
        modified=doc.one(iso_or_text(_first(m("modified"), m("metadata_processed"), m("metadata_modified")))),
        see_also=doc.one(F.when(domain(m("references")) != "", m("references"))),
        publisher=_only(
            m("publisher").isNotNull(),
            _node(PUBLISHER, ref=node_id(uri, F.lit("publisher"), m("publisher")), name=m("publisher")),
            PUBLISHER,
        ),
        distributions=F.concat(
            F.when(F.col("_records"), tables).otherwise(none),
            F.when(F.col("_records") & F.col("_geo"), maps).otherwise(none),
            F.transform(doc.elements(F.col("_doc"), "attachments"), attached),
        ),
    )


@_mapping
def data_gouv_fr() -> Stages:
    """Datasets of data.gouv.fr portals."""
    whole = F.col("_doc")
    names = ["id", "page", "title", "description", "frequency", "created_at", "last_modified", "last_update", "license"]
    given = {
        **{"f_" + n: _some(doc.get(whole, n)) for n in names},
        **{"o_" + n: _some(doc.get(whole, f"organization.{n}")) for n in ("id", "name", "page")},
    }
    f = lambda k: F.col("f_" + k)
    o = lambda k: F.col("o_" + k)
    text = lambda k: doc.one(doc.unwrap_label(f(k)))
    uri = angle(f("page"))
    lic = _only(
        f("license").isNotNull(),
        _node(LICENSE, ref=node_id(uri, F.lit("license"), f("license")), identifier=f("license")),
        LICENSE,
    )
    def resource(r: Column) -> Column:
        fmt, mime = _some(doc.get(r, "format")), _some(doc.get(r, "mime"))
        fnode = _node(FORMAT, ref=node_id(uri, F.lit("format"), fmt), label=F.trim(fmt), value=mime)
        return _distribution(
            ref=doc.get(r, "id"),
            license=F.col("_license"),
            title=doc.values(r, None, "title"),
            description=doc.values(r, None, "description"),
            issued=doc.values(r, None, "created_at"),
            modified=doc.values(r, None, "last_modified"),
            format=_only(fmt.isNotNull(), fnode, FORMAT),
            media_type=doc.one(mime),
            download_url=doc.one(doc.get(r, "url")),
            byte_size=_size(_some(doc.get(r, "filesize"))),
        )

    return [_parsed(), given, {"_license": lic}], _finish(
        uri=f("page"),
        identifier=doc.one(f("id")),
        title=text("title"),
        description=text("description"),
        landing_page=text("page"),
        frequency=text("frequency"),
        keywords=F.transform(F.coalesce(doc.get(F.col("_doc"), "tags", "array<string>"), _empty("array<string>")), lambda x: F.trim(x)),
        issued=doc.one(iso_or_text(f("created_at"))),
        modified=doc.one(iso_or_text(_first(f("last_modified"), f("last_update")))),
        publisher=_only(
            o("id").isNotNull() | o("name").isNotNull() | o("page").isNotNull(),
            _node(
                PUBLISHER,
                ref=F.coalesce(o("page"), node_id(uri, F.lit("publisher"), o("id"))),
                identifier=o("id"),
                name=o("name"),
                homepage=o("page"),
            ),
            PUBLISHER,
        ),
        distributions=F.transform(doc.elements(F.col("_doc"), "resources"), resource),
    )


FOAF, VCARD = "http://xmlns.com/foaf/0.1/", "http://www.w3.org/2006/vcard/ns#"
RDF, RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
SCHEMA, SKOS = "http://schema.org/", "http://www.w3.org/2004/02/skos/core#"


@_mapping
def json_ld() -> Stages:
    """Documents that are DCAT already, as a list of JSON-LD nodes."""
    nodes = F.try_variant_get(F.col("_doc"), "$", "array<map<string,variant>>")
    listing = {"_nodes": F.coalesce(nodes, F.array().cast("array<map<string,variant>>"))}

    def listed(node: Column, iri: str) -> Column:
        items = F.try_variant_get(F.try_element_at(node, F.lit(iri)), "$", "array<variant>")
        found = F.transform(items, lambda x: F.trim(F.coalesce(doc.get(x, "@value"), doc.get(x, "@id"))))
        return F.coalesce(F.array_compact(found), _empty("array<string>"))

    def first(node: Column, iri: str) -> Column:
        return F.get(listed(node, iri), F.lit(0))

    def ident(node: Column) -> Column:
        return F.try_variant_get(F.try_element_at(node, F.lit("@id")), "$", "string")

    def of_type(iri: str) -> Column:
        kinds = lambda n: F.try_variant_get(F.try_element_at(n, F.lit("@type")), "$", "array<string>")
        return F.filter(F.col("_nodes"), lambda n: F.coalesce(F.array_contains(kinds(n), iri), F.lit(False)))

    def by_id(ref: Column) -> Column:
        return F.try_element_at(F.col("_by_id"), ref)

    # the last of several nodes of a name would win: the list is turned round, so that it is the first
    named = F.filter(F.reverse("_nodes"), lambda n: ident(n).isNotNull())
    found = {
        "_ds": F.get(of_type(DCAT + "Dataset"), F.lit(0)),
        "_dists": of_type(DCAT + "Distribution"),
        "_by_id": F.map_from_entries(F.transform(named, lambda n: F.struct(ident(n).alias("key"), n.alias("value")))),
    }
    ds = F.col("_ds")

    def nodes_of(iri: str, kind: str, **props: str) -> Column:
        def build(ref: Column) -> Column:
            return _node(kind, ref=ref, **{n: first(by_id(ref), p) for n, p in props.items()})

        return F.transform(listed(ds, iri), build)

    def dist(n: Column) -> Column:
        licence = lambda ref: _node(
            LICENSE, ref=ref, label=first(by_id(ref), RDFS + "label"), identifier=first(by_id(ref), DCT + "identifier")
        )
        form = lambda ref: _node(
            FORMAT, ref=ref, label=first(by_id(ref), RDFS + "label"), value=first(by_id(ref), RDF + "value")
        )
        return _distribution(
            ref=ident(n),
            title=listed(n, DCT + "title"),
            description=listed(n, DCT + "description"),
            rights=listed(n, DCT + "rights"),
            license=F.transform(listed(n, DCT + "license"), licence),
            access_url=listed(n, DCAT + "accessURL"),
            download_url=listed(n, DCAT + "downloadURL"),
            media_type=listed(n, DCAT + "mediaType"),
            format=F.transform(listed(n, DCT + "format"), form),
            issued=listed(n, DCT + "issued"),
            modified=listed(n, DCT + "modified"),
            byte_size=listed(n, DCAT + "byteSize"),
        )

    plain = {
        "title": DCT + "title", "description": DCT + "description", "landing_page": DCAT + "landingPage",
        "identifier": DCT + "identifier", "frequency": DCT + "accrualPeriodicity",
        "keywords": DCAT + "keyword", "issued": DCT + "issued", "modified": DCT + "modified",
        "language": DCT + "language", "theme": DCAT + "theme", "conforms_to": DCAT + "conformsTo",
        "see_also": RDFS + "seeAlso",
    }
    return [_parsed(), listing, found], _finish(
        uri=ident(ds),
        **{name: listed(ds, iri) for name, iri in plain.items()},
        contact=nodes_of(DCAT + "contactPoint", CONTACT, fn=VCARD + "fn", email=VCARD + "hasEmail"),
        publisher=nodes_of(
            DCT + "publisher", PUBLISHER, identifier=DCT + "identifier", name=FOAF + "name",
            mbox=FOAF + "mbox", homepage=FOAF + "homepage",
        ),
        temporal=nodes_of(DCT + "temporal", TEMPORAL, start=SCHEMA + "startDate", end=SCHEMA + "endDate"),
        spatial=nodes_of(DCT + "spatial", SPATIAL, label=SKOS + "prefLabel"),
        distributions=F.transform(F.col("_dists"), dist),
    )


MAPPINGS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "CKAN": ckan,
    "Socrata": socrata,
    "OpenDataSoft": opendatasoft,
    "XMLDCAT": json_ld,
    "DataGouvFr": data_gouv_fr,
}


def to_dcat(records: DataFrame, softwares: list[str] | None = None) -> DataFrame:
    """Map records (software, apiuri, raw, keys) of all softwares to the DCAT columns.

    One branch per software: store records partitioned by software, and every branch reads
    only its own partition.
    """
    parts = [MAPPINGS[s](records.where(F.col("software") == s)) for s in softwares or MAPPINGS]
    return reduce(DataFrame.unionByName, parts)


def read_documents(spark, path: str, lines: bool = False) -> DataFrame:
    """Supplied documents below software=<name>/ folders: one JSON file each, or one per line of large files.

    The id is the file's name, or that and the number of the line's block and place.
    """
    file = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = spark.read.text(path, wholetext=not lines)
    name = F.concat_ws("-", file, F.col("_metadata.file_block_start").cast("string"), F.monotonically_increasing_id().cast("string")) if lines else file
    return rows.select(*[c for c in rows.columns if c != "value"], F.col("value").alias("raw"), name.alias("id"))
