"""Raw metadata documents of every portal software, written by Spark from the test tables.

A document row (view v_doc) and its two resources (view v_doc_resource) become the JSON a
portal of that software would answer with. Whole texts go in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.plans.views import Catalogue
from catascope.session import scratch

SNAPSHOT = 2401
KEYS = ["doc_id", "id", "portalid", "software", "apiuri", "portal_uri", "iso"]


def c(name: str) -> Column:
    return F.col(name)


def with_resources(cat: Catalogue) -> DataFrame:
    """Documents with their resources as an array; two each, by the view's definition."""
    res = cat.doc_resource.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "url", "res_id", "format", "mimetype", "size", "last_modified"))).alias("res")
    )
    return cat.doc.join(res, "doc_id")


def ckan_json() -> Column:
    resource = lambda r: F.struct(
        r["res_id"].alias("id"), r["res_id"].alias("name"), F.when(r["pos"] == 0, r["url"]).alias("url"),
        F.when(r["pos"] == 1, r["url"]).alias("download_url"), r["format"].alias("format"), r["mimetype"].alias("mimetype"),
        r["size"].alias("size"), r["last_modified"].alias("last_modified"),
    )
    extras = F.array(
        F.struct(F.lit("language").alias("key"), c("lang").alias("value")),
        F.struct(F.lit("spatial_text").alias("key"), F.coalesce(c("spatial_text"), F.lit("")).alias("value")),
        F.struct(F.lit("dcat_temporal_start").alias("key"), F.coalesce(c("temporal_start"), F.lit("")).alias("value")),
        F.struct(F.lit("frequency-of-update").alias("key"), F.coalesce(c("frequency"), F.lit("")).alias("value")),
    )
    return F.to_json(
        F.struct(
            "id", F.concat(F.lit("record-"), c("doc_id").cast("string")).alias("name"), "title", "notes",
            F.array(F.struct(c("lang").alias("name")), F.struct(c("source").alias("name"))).alias("tags"),
            c("created").alias("metadata_created"), c("modified").alias("metadata_modified"),
            c("contact_name").alias("maintainer"), c("contact_email").alias("maintainer_email"),
            F.when(c("org_title").isNotNull(), F.struct(c("source").alias("id"), c("org_title").alias("title"))).alias("organization"),
            "license_id", "license_title", "license_url", extras.alias("extras"),
            F.transform("res", resource).alias("resources"),
        )
    )


def socrata_view() -> Column:
    """A view of the listing; some are maps, which are not harvested."""
    return F.struct(
        "id",
        F.when(c("source") == "src12", "map").when(c("source") == "src13", "tabular").alias("viewType"),
        F.when(c("org_title").isNotNull(), F.struct(c("org_title").alias("displayName"))).alias("owner"),
        F.when(c("contact_name").isNotNull(), F.struct(c("contact_name").alias("displayName"))).alias("tableAuthor"),
    )


RDF_HEAD = (
    '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" '
    'xmlns:dcat="http://www.w3.org/ns/dcat#" xmlns:dct="http://purl.org/dc/terms/" xmlns:ods="urn:ods#">'
)


def _xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def rdf_xml() -> Column:
    """RDF/XML of a dataset with a download per resource."""
    tag = lambda name, text: F.when(text.isNotNull(), F.concat(F.lit(f"<{name}>"), _xml(text), F.lit(f"</{name}>"))).otherwise("")
    download = lambda r: F.concat(
        F.lit('<dcat:distribution><dcat:Download><dcat:accessURL rdf:resource="'), _xml(r["url"]), F.lit('"/>'),
        F.when(
            r["format"].isNotNull(),
            F.concat(F.lit("<dct:format><rdf:Description>"), tag("rdfs:label", r["format"]), tag("rdf:value", r["mimetype"]), F.lit("</rdf:Description></dct:format>")),
        ).otherwise(""),
        F.lit("</dcat:Download></dcat:distribution>"),
    )
    return F.concat(
        F.lit(RDF_HEAD + "<dcat:Dataset>"), tag("dct:title", c("title")), tag("dct:description", F.concat(c("lang"), F.lit(" "), c("source"))),
        tag("dct:identifier", c("id")), tag("dcat:keyword", c("lang")), tag("dcat:keyword", c("source")),
        tag("ods:created", c("created")), tag("ods:last_modified", c("modified")),
        F.array_join(F.transform("res", download), ""), F.lit("</dcat:Dataset></rdf:RDF>"),
    )


CATALOGUE_HEAD = RDF_HEAD[:-1] + ' xmlns:foaf="http://xmlns.com/foaf/0.1/" xmlns:vcard="http://www.w3.org/2006/vcard/ns#" xmlns:skos="http://www.w3.org/2004/02/skos/core#" xmlns:schema="http://schema.org/">'


def rdf_catalogue() -> Column:
    """RDF/XML of a dataset in a catalogue; its second resource is only referred to and stands apart."""
    tag = lambda name, text: F.when(text.isNotNull(), F.concat(F.lit(f"<{name}>"), _xml(text), F.lit(f"</{name}>"))).otherwise("")
    inside = lambda name, *parts: F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))
    given = lambda have, part: F.when(have.isNotNull(), part).otherwise("")
    name = F.concat(F.lit("urn:dist:"), c("id"))
    terms = F.coalesce("license_title", "license_id")

    def dist(r: Column, about: str | None) -> Column:
        head = F.lit("<dcat:Distribution>") if about is None else F.concat(F.lit('<dcat:Distribution rdf:about="'), name, F.lit('">'))
        link = F.concat(F.lit('<dcat:accessURL rdf:resource="'), _xml(r["url"]), F.lit('"/>'))
        licence = given(terms, inside("dct:license", inside("dct:LicenseDocument", tag("rdfs:label", terms))))
        return F.concat(head, link, tag("dct:format", r["format"]), licence, F.lit("</dcat:Distribution>"))

    first, second = (F.get("res", F.lit(i)) for i in (0, 1))
    dataset = F.concat(
        F.lit("<dcat:Dataset>"), tag("dct:title", c("title")), tag("dct:identifier", c("id")), tag("dcat:keyword", c("lang")),
        given(c("org_title"), inside("dct:publisher", inside("foaf:Organization", tag("foaf:name", c("org_title"))))),
        given(c("contact_name"), inside("dcat:contactPoint", inside("vcard:Kind", tag("vcard:fn", c("contact_name")), tag("vcard:hasEmail", c("contact_email"))))),
        tag("dct:accrualPeriodicity", c("frequency")),
        given(c("spatial_text"), inside("dct:spatial", inside("dct:Location", tag("skos:prefLabel", c("spatial_text"))))),
        given(c("temporal_start"), inside("dct:temporal", inside("dct:PeriodOfTime", tag("schema:startDate", c("temporal_start"))))),
        inside("dcat:distribution", dist(first, None)), F.lit('<dcat:distribution rdf:resource="'), name, F.lit('"/></dcat:Dataset>'),
    )
    return F.concat(dataset, dist(second, "apart"))


def xml_catalogues(cat: Catalogue) -> str:
    """Catalogue files of all portals, below portalid=/snapshot= folders."""
    path = scratch(cat.spark, "rdf")
    docs = with_resources(cat).select("portalid", F.lit(SNAPSHOT).alias("snapshot"), F.floor(c("doc_id") / 1000).alias("part"), rdf_catalogue().alias("body"))
    whole = docs.groupBy("portalid", "snapshot", "part").agg(F.array_join(F.collect_list("body"), "").alias("v"))
    whole = whole.select("portalid", "snapshot", F.concat(F.lit(CATALOGUE_HEAD), "v", F.lit("</rdf:RDF>")).alias("value"))
    whole.write.option("maxRecordsPerFile", 1).partitionBy("portalid", "snapshot").text(path)
    return path


EX = "urn:ex#"
REFERENCE_HEAD = CATALOGUE_HEAD[:-1] + f' xmlns:ex="{EX}">'


def rdf_by_reference(turned: bool = False) -> Column:
    """RDF/XML of a dataset that gives everything by reference; turned: in another order, with other blank names."""
    text = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), _xml(value), F.lit(f"</{name}>"))).otherwise("")
    given = lambda have, part: F.when(have.isNotNull(), part).otherwise("")
    blank = lambda place: F.concat(F.lit(("z" if turned else "b") + place), c("doc_id").cast("string"))
    to = lambda name, kind, ref: F.concat(F.lit(f'<{name} rdf:{kind}="'), ref, F.lit('"/>'))

    def node(tag: str, kind: str, name: Column, *parts: Column) -> Column:
        return F.concat(F.lit(f'<{tag} rdf:{kind}="'), name, F.lit('">'), *(reversed(parts) if turned else parts), F.lit(f"</{tag}>"))

    org, person = F.concat(F.lit("urn:org:"), c("source")), F.concat(F.lit("urn:person:"), c("lang"))
    place, desk = F.concat(F.lit("urn:place:"), c("lang")), F.concat(F.lit("urn:desk:"), c("lang"), F.lit("-"), c("source"))
    dist = lambda i: F.concat(F.lit("urn:dist:"), c("id"), F.lit(f"-{i}"))
    terms = F.coalesce("license_title", "license_id")
    dataset = node(
        "dcat:Dataset", "about", F.concat(F.lit("urn:dataset:"), c("id")), text("dct:title", c("title")), text("dct:identifier", c("id")), text("dcat:keyword", c("lang")),
        given(c("org_title"), to("dct:publisher", "resource", org)), given(c("contact_name"), to("dcat:contactPoint", "nodeID", blank("contact"))),
        text("dct:accrualPeriodicity", c("frequency")), given(c("spatial_text"), to("dct:spatial", "resource", place)),
        given(c("temporal_start"), to("dct:temporal", "nodeID", blank("period"))), to("ex:steward", "resource", person),
        *[to("dcat:distribution", "resource", dist(i)) for i in (0, 1)],
    )
    nodes = [
        given(c("org_title"), node("foaf:Organization", "about", org, text("foaf:name", c("org_title")))),
        given(c("contact_name"), node("vcard:Kind", "nodeID", blank("contact"), text("vcard:fn", c("contact_name")), text("vcard:hasEmail", c("contact_email")))),
        given(c("spatial_text"), node("dct:Location", "about", place, text("skos:prefLabel", c("spatial_text")))),
        given(c("temporal_start"), node("dct:PeriodOfTime", "nodeID", blank("period"), text("schema:startDate", c("temporal_start")))),
        node("foaf:Person", "about", person, text("ex:grade", c("lang")), to("ex:desk", "resource", F.concat(F.lit("urn:desk:"), c("lang")))),
        node("rdf:Description", "about", F.concat(F.lit("urn:desk:"), c("lang")), text("ex:room", F.concat(F.lit("room "), c("lang")))),
        given(terms, node("dct:LicenseDocument", "nodeID", blank("terms"), text("rdfs:label", terms), to("ex:signed", "resource", desk))),
        given(terms, node("rdf:Description", "about", desk, text("ex:by", c("source")))),
    ]
    for i in (0, 1):
        r = F.get("res", F.lit(i))
        form = blank(f"format{i}-")
        nodes.append(
            node(
                "dcat:Distribution", "about", dist(i), to("dcat:accessURL", "resource", _xml(r["url"])),
                given(r["format"], to("dct:format", "nodeID", form)), given(terms, to("dct:license", "nodeID", blank("terms"))),
            )
        )
        nodes.append(given(r["format"], node("rdf:Description", "nodeID", form, text("rdfs:label", r["format"]), text("rdf:value", r["mimetype"]))))
    every = [dataset, *nodes]
    return F.concat(*(reversed(every) if turned else every))


def reference_catalogues(cat: Catalogue, path: str | None = None, turned: bool = False) -> str:
    """Catalogue files by reference; turned: the next week's, with the same content written in another way."""
    path = path or scratch(cat.spark, "rdf")
    docs = with_resources(cat).withColumn("part", F.floor(c("doc_id") / 1000))
    order = F.struct((-F.col("doc_id") if turned else F.col("doc_id")).alias("at"), rdf_by_reference(turned).alias("body"))
    whole = docs.groupBy("portalid", "part").agg(F.array_sort(F.collect_list(order)).alias("v"))
    body = F.concat(F.lit(REFERENCE_HEAD), F.array_join(F.col("v.body"), ""), F.lit("</rdf:RDF>"))
    whole = whole.select("portalid", F.lit(SNAPSHOT + turned).alias("snapshot"), body.alias("value"))
    whole.write.mode("append").option("maxRecordsPerFile", 1).partitionBy("portalid", "snapshot").text(path)
    return path


def socrata_json() -> Column:
    return F.to_json(F.struct(socrata_view().alias("view"), rdf_xml().alias("dcat")))


def opendatasoft_json() -> Column:
    metas = F.struct(
        "title", c("notes").alias("description"), c("lang").alias("language"), F.array("lang", "source").alias("keyword"),
        c("org_title").alias("publisher"), "modified", F.coalesce("license_title", "license_id").alias("license"),
        c("created").alias("data_processed"),
    )
    attachments = F.transform(
        F.filter("res", lambda r: r["pos"] == 1),
        lambda r: F.struct(r["res_id"].alias("id"), r["res_id"].alias("title"), r["format"].alias("format"), r["mimetype"].alias("mimetype")),
    )
    return F.to_json(
        F.struct(
            c("id").alias("datasetid"), metas.alias("metas"), (c("lang") != "fr").alias("has_records"),
            F.when(c("lang") == "de", F.array(F.lit("geo"), F.lit("analyze"))).otherwise(F.array(F.lit("analyze"))).alias("features"),
            attachments.alias("attachments"),
        )
    )


def data_gouv_fr_json() -> Column:
    resource = lambda r: F.struct(
        r["res_id"].alias("id"), r["res_id"].alias("title"), r["format"].alias("format"), r["mimetype"].alias("mime"),
        r["url"].alias("url"), r["size"].cast("bigint").alias("filesize"), r["last_modified"].alias("last_modified"),
    )
    return F.to_json(
        F.struct(
            "id", F.concat(c("portal_uri"), F.lit("datasets/"), c("id")).alias("page"), "title", c("notes").alias("description"),
            "frequency", F.array("lang", "source").alias("tags"), c("created").alias("created_at"), c("modified").alias("last_modified"),
            F.when(c("org_title").isNotNull(), F.struct(c("source").alias("id"), c("org_title").alias("name"))).alias("organization"),
            c("license_id").alias("license"), F.transform("res", resource).alias("resources"),
        )
    )


def json_ld_text() -> Column:
    from catascope.operators.mapping import DCAT, DCT, FOAF, RDFS

    lit = lambda text: F.array(F.struct(text.alias("@value")))
    ref = lambda text: F.array(F.struct(text.alias("@id")))
    uri = F.concat(c("portal_uri"), F.lit("catalog/"), c("id"))
    has_org = c("org_title").isNotNull()
    org = F.concat(F.lit("_:org-"), c("source"))
    dataset = F.to_json(
        F.struct(
            uri.alias("@id"), F.array(F.lit(DCAT + "Dataset")).alias("@type"), lit(c("title")).alias(DCT + "title"),
            lit(c("notes")).alias(DCT + "description"), lit(c("id")).alias(DCT + "identifier"),
            F.array(F.struct(c("lang").alias("@value")), F.struct(c("source").alias("@value"))).alias(DCAT + "keyword"),
            lit(c("created")).alias(DCT + "issued"), F.when(c("modified").isNotNull(), lit(c("modified"))).alias(DCT + "modified"),
            F.when(has_org, ref(org)).alias(DCT + "publisher"),
            F.transform("res", lambda r: F.struct(F.concat(F.lit("_:"), r["res_id"]).alias("@id"))).alias(DCAT + "distribution"),
        )
    )
    publisher = F.when(
        has_org, F.to_json(F.struct(org.alias("@id"), F.array(F.lit(FOAF + "Organization")).alias("@type"), lit(c("org_title")).alias(FOAF + "name")))
    )
    has_license = F.coalesce(c("license_id"), c("license_title")).isNotNull()
    lic = F.concat(F.lit("_:lic-"), c("source"))
    licence = F.when(
        has_license,
        F.to_json(
            F.struct(
                lic.alias("@id"), F.array(F.lit(DCT + "LicenseDocument")).alias("@type"),
                F.when(c("license_title").isNotNull(), lit(c("license_title"))).alias(RDFS + "label"),
                F.when(c("license_id").isNotNull(), lit(c("license_id"))).alias(DCT + "identifier"),
            )
        ),
    )
    dists = F.transform(
        "res",
        lambda r: F.to_json(
            F.struct(
                F.concat(F.lit("_:"), r["res_id"]).alias("@id"), F.array(F.lit(DCAT + "Distribution")).alias("@type"),
                ref(r["url"]).alias(DCAT + "accessURL"), F.when(r["format"].isNotNull(), lit(r["format"])).alias(DCT + "format"),
                F.when(r["mimetype"].isNotNull(), lit(r["mimetype"])).alias(DCAT + "mediaType"),
                F.when(has_license, ref(lic)).alias(DCT + "license"),
            )
        ),
    )
    nodes = F.array_compact(F.concat(F.array(dataset, publisher, licence), dists))
    return F.concat(F.lit("["), F.array_join(nodes, ","), F.lit("]"))


BUILDERS = {
    "CKAN": ckan_json,
    "Socrata": socrata_json,
    "OpenDataSoft": opendatasoft_json,
    "DataGouvFr": data_gouv_fr_json,
    "XMLDCAT": json_ld_text,
}


def records(cat: Catalogue, software: str | None = None) -> DataFrame:
    """Raw records; with a software, all documents as if every portal used it."""
    docs = with_resources(cat)
    if software:
        docs = docs.withColumn("software", F.lit(software))
        raw = BUILDERS[software]()
    else:
        raw = F.coalesce(*[F.when(c("software") == s, build()) for s, build in BUILDERS.items()])
    return docs.select(*KEYS, F.lit(SNAPSHOT).alias("snapshot"), raw.alias("raw"), F.sha1(raw).alias("md5"))


def pages(cat: Catalogue, software: str) -> DataFrame:
    """Responses of a listing: hundred records per page, page by page with one overlap."""
    docs = with_resources(cat)
    item = {"CKAN": ckan_json, "OpenDataSoft": opendatasoft_json, "DataGouvFr": data_gouv_fr_json}.get(
        software, lambda: F.to_json(socrata_view())
    )()
    rows = docs.select("portalid", F.floor(c("doc_id") / 100).cast("int").alias("page"), "doc_id", item.alias("item"))
    again = rows.where(c("doc_id") % 100 == 99).withColumn("page", c("page") + 1)
    every = rows.unionByName(again)
    listed = every.groupBy("portalid", "page").agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), ",")
    before, after = {
        "CKAN": ('{"success":true,"result":{"results":[', "]}}"),
        "OpenDataSoft": ('{"datasets":[', "]}"),
        "DataGouvFr": ('{"data":[', "]}"),
        "Socrata": ("[", "]"),
    }[software]
    return listed.select("portalid", F.lit(SNAPSHOT).alias("snapshot"), "page", F.concat(F.lit(before), body, F.lit(after)).alias("body"))
