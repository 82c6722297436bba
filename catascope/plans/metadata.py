"""Queries over raw documents: harvest records, mapping, metrics, reports, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catascope.functions.licenses import OPEN_LICENSE_LABELS
from catascope.operators import access as ac
from catascope.operators import mapping as ma
from catascope.operators import quality as qu
from catascope.operators import reports as re
from catascope.operators import schema_org as so
from catascope.operators import triples as tr
from catascope.plans import rawdocs
from catascope.plans.catalogue import QUALITY_SQL, portal_quality
from catascope.plans.registry import query
from catascope.plans.scalars import LICENSE_SQL
from catascope.plans.views import Catalogue
from catascope.session import scratch
from catascope.sources import harvest as ha
from catascope.sources import registries as rg


def ckan_dcat(c: Catalogue):
    return ma.ckan(rawdocs.records(c, "CKAN"))


# Two resources of a document side by side; the second is given as a download.
DOC_SQL = """
with a as (select * from v_doc_resource where pos = 0), b as (select * from v_doc_resource where pos = 1),
d as (select v.*, a.url as url0, b.url as url1, a.format as f0, b.format as f1, a.mimetype as m0, b.mimetype as m1, a.size as s0, b.size as s1,
  a.last_modified as lm0, b.last_modified as lm1, a.res_id as r0, b.res_id as r1
  from v_doc v join a on a.doc_id = v.doc_id join b on b.doc_id = v.doc_id)
"""


@query("ckan_records", """
select portalid, 2401 as snapshot, id, concat('record-', cast(doc_id as varchar)) as name, title, length(notes) as note_length from v_doc""")
def ckan_records(c: Catalogue):
    rows = ha.ckan_records(rawdocs.pages(c, "CKAN"))
    json = lambda k: F.get_json_object("raw", f"$.{k}")
    return rows.select("portalid", "snapshot", "id", json("name").alias("name"), json("title").alias("title"), F.length(json("notes")).cast("bigint").alias("note_length"))


@query("ckan_completed_records", "select portalid, 2401 as snapshot, id from v_doc")
def ckan_completed_records(c: Catalogue):
    """A listing that lost its first page, completed from single records of all documents."""
    listed = _landed(c, "CKAN").where("page > 0")
    singles = rawdocs.records(c, "CKAN").select(
        "portalid", "snapshot", F.col("doc_id").cast("int").alias("page"), F.concat(F.lit('{"result":'), "raw", F.lit("}")).alias("body")
    )
    return ha.ckan_records(listed, singles).select("portalid", "snapshot", "id")


@query("socrata_records", "select portalid, 2401 as snapshot, id, case source when 'src13' then 'tabular' end as view_type, lang <> 'de' as has_dcat from v_doc where source <> 'src12'")
def socrata_records(c: Catalogue):
    text = rawdocs.with_resources(c).where("lang <> 'de'").select(
        "portalid", F.lit(rawdocs.SNAPSHOT).alias("snapshot"), "id", rawdocs.rdf_xml().alias("dcat")
    )
    rows = ha.socrata_records(_landed(c, "Socrata"), text)
    return rows.select(
        "portalid", "snapshot", "id", F.get_json_object("raw", "$.view.viewType").alias("view_type"),
        F.get_json_object("raw", "$.dcat").isNotNull().alias("has_dcat"),
    )


@query("opendatasoft_records", "select portalid, 2401 as snapshot, id, title from v_doc")
def opendatasoft_records(c: Catalogue):
    rows = ha.opendatasoft_records(_landed(c, "OpenDataSoft"))
    return rows.select("portalid", "snapshot", "id", F.get_json_object("raw", "$.metas.title").alias("title"))


@query("data_gouv_fr_records", "select portalid, 2401 as snapshot, id, title from v_doc")
def data_gouv_fr_records(c: Catalogue):
    rows = ha.data_gouv_fr_records(_landed(c, "DataGouvFr"))
    return rows.select("portalid", "snapshot", "id", F.get_json_object("raw", "$.title").alias("title"))


def _landed(c: Catalogue, software: str):
    """The pages of a software written as a crawler lands them, a line each, and read back."""
    path = scratch(c.spark, "pages")
    ha.write_pages(rawdocs.pages(c, software), path)
    return ha.read_pages(c.spark, path, lines=True)


PAGES_SQL = """
with pages as (select distinct portalid, software, page from (select portalid, software, doc_id // 100 as page from v_doc
  union all select portalid, software, doc_id // 100 + 1 from v_doc where doc_id % 100 = 99) x)"""


@query("rejected_pages", PAGES_SQL + """
select portalid, software, 2401 as snapshot, cast(page as int) as page, case page % 4 when 1 then 'not JSON' when 2 then 'no records' else 'empty' end as reason
from pages where page % 4 > 0 and software <> 'XMLDCAT'""")
def rejected_pages(c: Catalogue):
    """Three of four pages are broken: cut off, an error message, or nothing at all."""
    n = F.col("page") % 4
    broken = F.when(n == 0, F.col("body")).when(n == 1, F.expr("substring(body, 1, length(body) - 1)")).when(n == 2, F.lit('{"success":false,"error":"x"}'))
    out = None
    for software in ha.PLACES:
        portals = c.portal.where(F.col("software") == software).select(F.col("id").alias("portalid"))
        pages = rawdocs.pages(c, software).join(portals, "portalid", "left_semi").withColumn("body", broken)
        rows = ha.rejected_pages(pages, software).withColumn("software", F.lit(software))
        out = rows if out is None else out.unionByName(rows)
    return out.select("portalid", "software", "snapshot", "page", "reason")


@query("records_beside_broken_pages", "select portalid, 2401 as snapshot, id from v_doc where doc_id % 100 <> 99 and (doc_id // 100) % 2 = 1 or doc_id % 100 = 99")
def records_beside_broken_pages(c: Catalogue):
    """Every second page is cut off; the records of the others are there, with the overlap of the pages."""
    body = F.when(F.col("page") % 2 == 1, F.col("body")).otherwise(F.expr("substring(body, 1, length(body) - 1)"))
    return ha.ckan_records(rawdocs.pages(c, "CKAN").withColumn("body", body)).select("portalid", "snapshot", "id")


@query("extras_map", "select doc_id, lang, coalesce(spatial_text, '') as spatial, coalesce(frequency, '') as frequency from v_doc")
def extras_map(c: Catalogue):
    rows = ha.with_normal_extras(rawdocs.records(c, "CKAN"))
    at = lambda k: F.try_element_at("extras", F.lit(k))
    return rows.select("doc_id", at("language").alias("lang"), at("spatial_text").alias("spatial"), at("frequency-of-update").alias("frequency"))


ISO = "case {0} when 'unknown' then {0} else {0} || 'T00:00:00' end"


@query("ckan_to_dcat", DOC_SQL + f"""
select doc_id, concat(apiuri, '/dataset/', id) as uri, nullif(title, '') as title, case when length(notes) = 0 then null else md5(trim(notes)) end as description_md5, lang as language, lang as keyword1, source as keyword2,
  {ISO.format('created')} as issued, modified || 'T00:00:00' as modified, frequency, spatial_text as spatial,
  temporal_start || 'T00:00:00' as temporal_start, contact_name, contact_email, org_title as publisher,
  case when org_title is not null then concat(apiuri, '/organization/', source) end as publisher_ref,
  url0 as access_url, url1 as download_url, r1 as second_title, case when f0 like '%/%' then null else trim(f0) end as first_format,
  case when f0 like '%/%' then f0 else m0 end as first_media, cast(cast(s0 as bigint) as varchar) as first_size, lm1 as second_modified,
  cast((case when license_id is null and license_title is null and license_url is null then 0 else 1 end) as int) as licenses
from d""")
def ckan_to_dcat(c: Catalogue):
    rows = ckan_dcat(c)
    first = lambda col: F.get(col, F.lit(0))
    d0, d1 = F.col("distributions")[0], F.col("distributions")[1]
    return rows.select(
        "doc_id",
        "uri",
        first("title").alias("title"),
        F.md5(first("description")).alias("description_md5"),
        first("language").alias("language"),
        F.col("keywords")[0].alias("keyword1"),
        F.col("keywords")[1].alias("keyword2"),
        first("issued").alias("issued"),
        first("modified").alias("modified"),
        first("frequency").alias("frequency"),
        first("spatial")["label"].alias("spatial"),
        first("temporal")["start"].alias("temporal_start"),
        first("contact")["fn"].alias("contact_name"),
        first("contact")["email"].alias("contact_email"),
        first("publisher")["name"].alias("publisher"),
        first("publisher")["ref"].alias("publisher_ref"),
        first(d0["access_url"]).alias("access_url"),
        first(d1["download_url"]).alias("download_url"),
        first(d1["title"]).alias("second_title"),
        first(d0["format"])["label"].alias("first_format"),
        first(d0["media_type"]).alias("first_media"),
        F.regexp_replace(first(d0["byte_size"]), r"\.0$", "").alias("first_size"),
        first(d1["modified"]).alias("second_modified"),
        F.size(d0["license"]).alias("licenses"),
    )


@query("documents_to_dcat", DOC_SQL + """
select doc_id, software, portalid, nullif(title, '') as title, org_title as publisher, lang as keyword1,
  cast(case when software = 'OpenDataSoft' then case lang when 'fr' then 1 when 'de' then 6 else 4 end else 2 end as int) as distributions,
  case software when 'CKAN' then coalesce(license_id, license_title) when 'OpenDataSoft' then coalesce(license_title, license_id) when 'DataGouvFr' then license_id
    when 'XMLDCAT' then coalesce(license_id, license_title) end as license_given
from d""")
def documents_to_dcat(c: Catalogue):
    rows = ma.to_dcat(rawdocs.records(c))
    node = F.get(ac.license_nodes(), F.lit(0))
    return rows.select(
        "doc_id",
        "software",
        "portalid",
        F.get("title", F.lit(0)).alias("title"),
        F.get("publisher", F.lit(0))["name"].alias("publisher"),
        F.get("keywords", F.lit(0)).alias("keyword1"),
        F.size("distributions").alias("distributions"),
        F.coalesce(node["identifier"], node["label"]).alias("license_given"),
    )


@query("socrata_to_dcat", DOC_SQL + f"""
select doc_id, concat(apiuri, '/dataset/', id) as uri, id as identifier, {ISO.format('created')} as issued, modified || 'T00:00:00' as modified,
  contact_name as contact, org_title as publisher, url1 as second_url, trim(f1) as second_format, m1 as second_media from d""")
def socrata_to_dcat(c: Catalogue):
    rows = ma.socrata(rawdocs.records(c, "Socrata"))
    first = lambda col: F.get(col, F.lit(0))
    d1 = F.col("distributions")[1]
    return rows.select(
        "doc_id", "uri", first("identifier").alias("identifier"), first("issued").alias("issued"), first("modified").alias("modified"),
        first("contact")["fn"].alias("contact"), first("publisher")["name"].alias("publisher"), first(d1["access_url"]).alias("second_url"),
        F.trim(first(d1["format"])["label"]).alias("second_format"),
        F.when(F.size(d1["format"]) > 0, first(d1["media_type"])).alias("second_media"),
    )


@query("resources_of_documents", DOC_SQL + r"""
, r as (select id as md5, 0 as p, url0 as url, f0 as f, m0 as m, s0 as s, lm0 as lm from d union all select id, 1, url1, f1, m1, s1, lm1 from d),
n as (select md5, p, case when regexp_matches(url, '^[a-z]+://[^/?#]+($|[?#])') then regexp_replace(url, '^([a-z]+://[^/?#]+)', '\1/') else url end as uri, f, m, s, lm from r),
k as (select *, row_number() over (partition by md5, uri order by p) as i from n)
select uri, md5, true as valid, case when f like '%/%' then null else regexp_replace(lower(trim(f)), '^\.', '') end as format, case when f like '%/%' then f else m end as media,
  cast(s as bigint) as size, try_strptime(lm, '%Y-%m-%dT%H:%M:%S') as modified from k where i = 1""")
def resources_of_documents(c: Catalogue):
    rows = ckan_dcat(c).withColumn("md5", F.col("id"))
    return ac.resources(rows).select("uri", "md5", "valid", "format", "media", "size", "modified")


@query("content_rows", f"""
with l as ({LICENSE_SQL})
select v.doc_id, try_strptime(modified, '%Y-%m-%d') as modified, try_strptime(created, '%Y-%m-%d') as created, coalesce(org_title, contact_name) as organisation, license
from v_doc v join l on l.doc_id = v.doc_id""")
def content_rows(c: Catalogue):
    rows = ckan_dcat(c).withColumn("md5", F.col("doc_id"))
    return ac.content_rows(rows).select(F.col("md5").alias("doc_id"), "modified", "created", "organisation", "license")


@query("dataset_rows", "select id, 2401 as snapshot, portalid, coalesce(org_title, contact_name) as organisation, nullif(title, '') as title from v_doc")
def dataset_rows(c: Catalogue):
    return ac.dataset_rows(ckan_dcat(c)).select("id", "snapshot", "portalid", "organisation", "title")


@query("organisation_urls", "select doc_id, case when org_title is not null then concat(apiuri, '/organization/', source) end as org_url, contact_name is not null or contact_email is not null as has_contact from v_doc")
def organisation_urls(c: Catalogue):
    ref = ac.organisation_url()
    return ckan_dcat(c).select(
        "doc_id", F.when(~ref.startswith("_:"), ref).alias("org_url"), (F.size("contact") > 0).alias("has_contact")
    )


@query("distribution_values", DOC_SQL + """
select doc_id, concat(url0, ' ', url1) as urls, case when f0 like '%/%' then nullif(trim(coalesce(case when f1 like '%/%' then null else f1 end, '')), '') else nullif(trim(concat(trim(coalesce(f0, '')), ' ', trim(coalesce(case when f1 like '%/%' then null else f1 end, '')))), '') end as formats from d""")
def distribution_values(c: Catalogue):
    urls = F.concat(ac.distribution_values("access_url"), ac.distribution_values("download_url"))
    formats = F.array_join(ac.distribution_formats(), " ")
    return ckan_dcat(c).select("doc_id", F.array_join(urls, " ").alias("urls"), F.when(formats != "", formats).alias("formats"))


@query("dcat_triples")
def dcat_triples(c: Catalogue):
    return tr.dcat_triples(ma.to_dcat(rawdocs.records(c)), ["doc_id"], "portal_uri")


@query("dcat_triple_counts", DOC_SQL + f"""
select 'http://purl.org/dc/terms/title' as p, count(*) filter (where title <> '') + 2 * count(*) as triples from d where software = 'CKAN'
union all select 'http://purl.org/dc/terms/identifier', count(*) + count(*) filter (where license_id is not null) from d where software = 'CKAN'
union all select 'http://www.w3.org/ns/dcat#dataset', count(*) from d where software = 'CKAN'
union all select 'http://www.w3.org/ns/dcat#distribution', 2 * count(*) from d where software = 'CKAN'
union all select 'http://www.w3.org/ns/dcat#accessURL', count(*) from d where software = 'CKAN'
union all select 'http://www.w3.org/2006/vcard/ns#hasEmail', count(contact_email) from d where software = 'CKAN'""")
def dcat_triple_counts(c: Catalogue):
    wanted = [ma.DCT + "title", ma.DCT + "identifier", ma.DCAT + "dataset", ma.DCAT + "distribution", ma.DCAT + "accessURL", ma.VCARD + "hasEmail"]
    rows = tr.dcat_triples(ma.to_dcat(rawdocs.records(c), ["CKAN"]), ["doc_id"], "portal_uri")
    return rows.where(F.col("p").isin(wanted)).groupBy("p").agg(F.count(F.lit(1)).alias("triples"))


@query("n_triples")
def n_triples(c: Catalogue):
    rows = tr.dcat_triples(ma.to_dcat(rawdocs.records(c)), ["portalid"], "portal_uri")
    return tr.n_triples(rows, ["portalid"])


@query("json_ld_nodes")
def json_ld_nodes(c: Catalogue):
    rows = tr.dcat_triples(ma.to_dcat(rawdocs.records(c)), ["portalid", "md5"])
    return tr.json_ld_nodes(rows, ["portalid", "md5"])


@query("schema_org", DOC_SQL + f"""
select doc_id, 'Dataset' as kind, concat(apiuri, '/dataset/', id) as ident, nullif(title, '') as name, org_title as publisher, case when org_title is not null then contact_email end as email, lang as language, {ISO.format('created')} as published,
  concat('Underlying software: ', 'CKAN') as catalog, url0 as first_url, url1 as second_url, coalesce(case when license_url is not null then license_url end, license_title, license_id) as license from d""")
def schema_org(c: Catalogue):
    docs = so.schema_org(ckan_dcat(c), ["doc_id"])
    at = lambda path, name: F.get_json_object("doc", path).alias(name)
    return docs.select(
        "doc_id", at("$['@type']", "kind"), at("$['@id']", "ident"), at("$.name", "name"), at("$.publisher.name", "publisher"),
        at("$.publisher.email", "email"), at("$.inLanguage", "language"), at("$.datePublished", "published"),
        at("$.catalog.description", "catalog"), at("$.distribution[0].contentUrl", "first_url"), at("$.distribution[1].contentUrl", "second_url"),
        at("$.distribution[0].license", "license"),
    )


@query("schema_org_pages", """
select portalid, replace(replace(to_base64(encode(id)), '+', '-'), '/', '_') as file, 'Dataset' as kind, nullif(title, '') as name, 'http://schema.org' as context from v_doc""")
def schema_org_pages(c: Catalogue):
    """The pages of all documents written, read back and parsed."""
    from catascope.sources import sinks

    path = scratch(c.spark, "html")
    sinks.write_pages(so.schema_org(ma.to_dcat(rawdocs.records(c)), ["portalid", "id"]), path)
    rows = c.spark.read.schema("portalid string, file string, value string").json(path)
    doc = F.regexp_extract("value", r"(?s)^<!DOCTYPE html><html><script type=.application/ld.json.>(.*)</script></html>$", 1)
    at = lambda path: F.get_json_object(doc, path)
    return rows.select("portalid", "file", at("$['@type']").alias("kind"), at("$.name").alias("name"), at("$['@context']").alias("context"))


FILLED = "case when {0} is null or {0} = '' then 0.0::double else 1.0::double end"
PAIR = "((case when {0} is null then 0 else 1 end) + (case when {1} is null then 0 else 1 end))"
# share of filled values: these arrays only hold filled values, so it is 0 or 1
ANY = "case when {0} is null and {1} is null then 0.0::double else 1.0::double end"
FMT = "(case when {0} like '%/%' then null else {0} end)"
MED = "(case when {0} like '%/%' then {0} else {1} end)"


@query("quality_existence", DOC_SQL + f"""
select doc_id, true as exac, (contact_name is not null or contact_email is not null or org_title is not null) as exco,
  round(({FILLED.format('title')} + {FILLED.format('notes')} + 1 + 1 + 0) / 5, 6) as exdi,
  round(({FILLED.format('frequency')} + {ANY.format(FMT.format('f0'), FMT.format('f1'))} + {ANY.format(MED.format('f0', 'm0'), MED.format('f1', 'm1'))} + {ANY.format('s0', 's1')}) / 4, 6) as expr,
  round((1 + {FILLED.format('modified')} + 0 + {ANY.format('lm0', 'lm1')}) / 4, 6) as exda,
  case when license_id is null and license_title is null and license_url is null then 0.0::double else 1.0::double end as exri,
  {FILLED.format('temporal_start')} as exte, {FILLED.format('spatial_text')} as exsp
from d""")
def quality_existence(c: Catalogue):
    rows = qu.quality(ckan_dcat(c), list(qu.EXISTENCE), ["doc_id"])
    return rows.select("doc_id", "exac", "exco", *[F.round(m, 6).alias(m) for m in ("exdi", "expr", "exda", "exri", "exte", "exsp")])


IANA = "('csv', 'json', 'pdf', 'text/csv', 'application/pdf', 'text/html')"
NORM = r"regexp_replace(lower(trim({0})), '^\.', '')"


def _share(values: list[str], test: str) -> str:
    n = " + ".join(f"(case when {v} is null then 0 else 1 end)" for v in values)
    hits = " + ".join(f"(case when {v} is not null and {test.format(v)} then 1 else 0 end)" for v in values)
    return f"case when {n} > 0 then round(({hits}) / ({n}), 6) end"


FORMATS = [FMT.format("f0"), FMT.format("f1")]
MEDIA = [MED.format("f0", "m0"), MED.format("f1", "m1")]
EMAIL = r"coalesce(regexp_matches({0}, '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+'), false)"


@query("quality_conformance", DOC_SQL.replace("d as (", f"l as ({LICENSE_SQL}), d as (") + f"""
select d.doc_id, true as coac,
  case when contact_name is null and contact_email is null and org_title is null then null else {EMAIL.format('contact_email')} end as coce,
  case when contact_name is null and contact_email is null and org_title is null then null else coalesce(contact_email like 'http://%', false) end as cocu,
  round((case when created <> 'unknown' then 1 else 0 end + case when modified is null then 0 else 1 end + case when lm0 is null and lm1 is null then 0 else 1 end)
    / (1 + case when modified is null then 0 else 1 end + case when lm0 is null and lm1 is null then 0 else 1 end), 6) as coda,
  {_share(FORMATS + MEDIA, NORM + ' in ' + IANA)} as cofo,
  case when license is null then null else license in ('CC-BY-4.0', 'CC0-1.0', 'ODC-BY-1.0', 'other-closed') end as coli
from d join l on l.doc_id = d.doc_id""")
def quality_conformance(c: Catalogue):
    rows = qu.quality(ckan_dcat(c), list(qu.CONFORMANCE), ["doc_id"])
    return rows.select("doc_id", "coac", "coce", "cocu", F.round("coda", 6).alias("coda"), F.round("cofo", 6).alias("cofo"), "coli")


@query("quality_openness", DOC_SQL.replace("d as (", f"l as ({LICENSE_SQL}), d as (") + f"""
select d.doc_id, {_share(FORMATS, NORM + " in ('csv', 'json', 'pdf')")} as opfo, {_share(FORMATS, NORM + " in ('csv', 'json', 'shp')")} as opma,
  case when license is null then null else license in ('CC-BY-4.0', 'CC0-1.0', 'ODC-BY-1.0') end as opli
from d join l on l.doc_id = d.doc_id""")
def quality_openness(c: Catalogue):
    rows = qu.quality(ckan_dcat(c), list(qu.OPENNESS), ["doc_id"])
    return rows.select("doc_id", F.round("opfo", 6).alias("opfo"), F.round("opma", 6).alias("opma"), "opli")


@query("quality_extra", """
select doc_id, case when lang = 'en' then 0.0::double else 1.0::double end as identifier, case when source in ('src1', 'src2') then 1.0::double else 0.0::double end as theme,
  case when source = 'src3' then 0.0::double else 1.0::double end as language from v_doc""")
def quality_extra(c: Catalogue):
    """Documents of which some have no identifier, some a theme, and some no language."""
    docs = rawdocs.with_resources(c)
    some = lambda when, name, value: F.when(when, F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,string>"))
    extras = F.map_concat(
        some(F.col("source").isin("src1", "src2"), "theme", F.col("lang")), some(F.col("source") != "src3", "language", F.col("lang"))
    )
    raw = F.to_json(F.struct("title", F.when(F.col("lang") != "en", F.col("id")).alias("id"), extras.alias("extras")))
    rows = docs.select("doc_id", "apiuri", raw.alias("raw"))
    return qu.quality(ma.ckan(rows), ["identifier", "theme", "language"], ["doc_id"], extra=True)


@query("supplied_documents", "select software, id, nullif(title, '') as title from v_doc")
def supplied_documents(c: Catalogue):
    """Documents of all softwares, supplied as files of one document per line, and mapped."""
    path = scratch(c.spark, "documents")
    rows = rawdocs.records(c).select("software", F.col("raw").alias("value"))
    rows.write.partitionBy("software").text(path)
    read = ma.read_documents(c.spark, path, lines=True).withColumn("apiuri", F.lit("http://example.org/api"))
    dcat = ma.to_dcat(read)
    first = lambda name: F.get(name, F.lit(0))
    return dcat.select("software", first("identifier").alias("id"), first("title").alias("title"))


@query("quality_all_softwares")
def quality_all_softwares(c: Catalogue):
    return qu.quality(ma.to_dcat(rawdocs.records(c)), keys=["doc_id", "software"], extra=True)


@query("registered_formats", DOC_SQL + f"select id as md5, cofo from (select id, {_share(FORMATS + MEDIA, NORM + ' in ' + IANA)} as cofo from d) x where cofo is not null")
def registered_formats(c: Catalogue):
    from catascope.functions.formats import common_registry

    tokens = c.spark.createDataFrame([(t,) for t in common_registry()], "token string")
    rows = qu.registered_format_share(ckan_dcat(c).withColumn("md5", F.col("id")), tokens)
    return rows.select("md5", F.round("cofo", 6).alias("cofo"))


@query("registered_licenses", f"""
with l as ({LICENSE_SQL})
select v.id as md5, license in ('CC-BY-4.0', 'CC0-1.0', 'ODC-BY-1.0', 'other-closed') as coli, license in ('CC-BY-4.0', 'CC0-1.0', 'ODC-BY-1.0') as opli
from v_doc v join l on l.doc_id = v.doc_id where license is not null""")
def registered_licenses(c: Catalogue):
    return qu.license_conformance(ckan_dcat(c).withColumn("md5", F.col("id")), rg.license_table(c.spark))


@query("format_counts", DOC_SQL + r"""
select value, count(*) as count from (select trim(f0) as value from d where f0 not like '%/%' union all select trim(f1) from d where f1 not like '%/%') x group by value""")
def format_counts(c: Catalogue):
    return qu.element_counts(ckan_dcat(c), ac.distribution_formats())


@query("open_license_labels", f"""
select doc_id, coalesce(license_id, license_title) in ({', '.join("'" + x + "'" for x in OPEN_LICENSE_LABELS)}) as listed from v_doc where coalesce(license_id, license_title) is not null""")
def open_license_labels(c: Catalogue):
    given = F.coalesce("license_id", "license_title")
    return c.doc.where(given.isNotNull()).select("doc_id", given.isin(OPEN_LICENSE_LABELS).alias("listed"))


def _long_sql() -> str:
    parts = []
    for code, dimension, label, _ in re.METRICS:
        m = code.lower()
        parts.append(f"select portalid, snapshot, '{m}' as metric, '{dimension}' as dimension, '{label}' as label, {m} as value, round(\"{m}N\" / datasets, 6) as perc from q where {m} is not null")
    return f"with q as ({QUALITY_SQL}) " + " union all ".join(parts)


@query("quality_long", _long_sql())
def quality_long(c: Catalogue):
    rows = re.long_quality(portal_quality(c))
    return rows.withColumn("perc", F.round("perc", 6))


def _fail_sql() -> str:
    parts = []
    for code, kind, explanation, improvement in re.HINTS:
        m = code.lower()
        v = f"cast(cast({m} as int) as double)" if m in qu.BOOLEAN_METRICS else m
        text = "null" if explanation is None else f"'{explanation}'"
        typ = "null" if kind is None else f"'{kind}'"
        parts.append(f"select md5, '{code}' as metric, {v} as value, {text} as explanation, '{improvement}' as improvement, {typ} as type from v_datasetquality where coalesce({v}, 0) < 1")
    return " union all ".join(parts)


@query("quality_report", _fail_sql())
def quality_report(c: Catalogue):
    return re.failing_metrics(c.datasetquality)


@query("document_contacts", """
select doc_id, case when contact_name is not null then contact_email end as contact_to from v_doc""")
def document_contacts(c: Catalogue):
    return re.with_contact(ckan_dcat(c)).select("doc_id", "contact_to")


@query("organisation_contacts", """
select distinct d.portalid, d.snapshot, d.organisation, c.contact_to from v_dataset d join v_content c on c.md5 = d.md5 where contact_to is not null""")
def organisation_contacts(c: Catalogue):
    return re.organisation_contacts(c.dataset, c.content)


@query("organisation_report", f"""
with f as (select md5, count(*) as failing from ({_fail_sql()}) x group by md5),
s as (select m.md5, r.snapshot, count(*) as lookups, count(*) filter (where status = 200) as ok, count(*) filter (where status = 404) as missing
  from v_metaresource m join v_resourceinfo r on r.uri = m.uri group by all)
select d.portalid, d.snapshot, d.organisation, c.contact_to, count(*) as datasets, cast(coalesce(sum(failing), 0) as bigint) as failing,
  cast(coalesce(sum(lookups), 0) as bigint) as lookups, cast(coalesce(sum(ok), 0) as bigint) as ok, cast(coalesce(sum(missing), 0) as bigint) as missing
from v_dataset d join v_content c on c.md5 = d.md5 join v_datasetquality q on q.md5 = d.md5 left join f on f.md5 = d.md5 left join s on s.md5 = d.md5 and s.snapshot = d.snapshot
where contact_to is not null group by all""")
def organisation_report(c: Catalogue):
    return re.organisation_report(c.dataset, c.content, c.datasetquality, c.metaresource, c.resourceinfo)


@query("organisation_summary", """
with u as (select distinct d.portalid, d.snapshot, d.organisation, m.uri from v_dataset d join v_content c on c.md5 = d.md5 join v_metaresource m on m.md5 = d.md5 where contact_to is not null)
select u.portalid, u.snapshot, u.organisation, count(*) as totaluris, count(r.status) as total, count(*) filter (where r.status = 200) as ok, count(*) filter (where r.status = 404) as missing,
  round(case when count(r.status) > 0 then count(*) filter (where r.status = 200) / count(r.status) else 0 end, 6) as ok_share,
  round(case when count(r.status) > 0 then count(*) filter (where r.status = 404) / count(r.status) else 0 end, 6) as missing_share
from u left join v_resourceinfo r on r.uri = u.uri and r.snapshot = u.snapshot group by all""")
def organisation_summary(c: Catalogue):
    rows = re.organisation_summary(c.dataset, c.content, c.metaresource, c.resourceinfo)
    return rows.withColumns({n: F.round(n, 6) for n in ("ok_share", "missing_share")})


def _measures(c: Catalogue):
    rows = c.dataset.select("portalid", "snapshot", "id", "md5").join(c.datasetquality, "md5")
    uri = F.concat(F.lit("http://"), F.lower("portalid"), F.lit(".example.org/"), "id")
    return tr.measure_rows(rows.withColumn("uri", uri))


def _measure_sql() -> str:
    parts = []
    for metric, name, _ in tr.MEASURES:
        v = f"case {metric} when true then 'true' when false then 'false' end" if metric in qu.BOOLEAN_METRICS else f"cast({metric} as varchar)"
        parts.append(f"select concat('http://', lower(portalid), '.example.org/', id) as dataset, snapshot, 'urn:catascope:quality#{name}' as metric, {v} as value from v_dataset d join v_datasetquality q on q.md5 = d.md5")
    return " union all ".join(parts)


@query("quality_measures", f"""
select dataset, snapshot, metric, value, concat('_:', sha1(concat('<', dataset, '>', cast(snapshot as varchar), '<', metric, '>', coalesce(value, 'None')))) as measure from ({_measure_sql()}) x""")
def quality_measures(c: Catalogue):
    return _measures(c).select("dataset", "snapshot", "metric", "value", "measure")


@query("measure_triples", f"""
with m as (select dataset, snapshot, metric, value, concat('_:', sha1(concat('<', dataset, '>', cast(snapshot as varchar), '<', metric, '>', coalesce(value, 'None')))) as measure,
  concat('urn:catascope:harvest/', cast(snapshot as varchar)) as act from ({_measure_sql()}) x)
select measure as s, '{tr.DQV}isMeasurementOf' as p, metric as o, 'uri' as o_kind, cast(null as varchar) as o_type from m
union all select measure, '{tr.DQV}value', coalesce(value, 'None'), 'literal', null from m
union all select dataset, '{tr.DQV}hasQualityMeasurement', measure, 'bnode', null from m
union all select measure, '{tr.TYPE}', '{tr.DQV}QualityMeasurement', 'uri', null from m
union all select measure, '{tr.DQV}computedOn', dataset, 'uri', null from m
union all select measure, '{tr.TYPE}', '{tr.PROV}Entity', 'uri', null from m
union all select measure, '{tr.PROV}wasDerivedFrom', dataset, 'uri', null from m
union all select measure, '{tr.PROV}wasGeneratedBy', act, 'uri', null from m
union all select act, '{tr.PROV}generated', measure, 'bnode', null from m""")
def measure_triples(c: Catalogue):
    activity = F.concat(F.lit("urn:catascope:harvest/"), F.col("snapshot").cast("string"))
    return tr.measure_triples(_measures(c).withColumn("activity", activity), "activity")


@query("dqv_vocabulary", "select count(*) as measures, count(distinct metric) as metrics from (" + _measure_sql() + ") x")
def dqv_vocabulary(c: Catalogue):
    """Every exported measure refers to a metric of the vocabulary."""
    metrics = tr.vocabulary(c.spark).where(F.col("o") == tr.DQV + "Metric").select(F.col("s").alias("metric"))
    used = _measures(c).join(metrics, "metric", "left_semi")
    return used.agg(F.count(F.lit(1)).alias("measures"), F.countDistinct("metric").alias("metrics"))


@query("week_provenance", """
select snapshot, concat('urn:catascope:csvw/', cast(snapshot as varchar)) as s, 'http://www.w3.org/ns/prov#startedAtTime' as p, cast(cast(date_trunc('week', make_date(2000 + snapshot // 100, 1, 4)) as date) + (snapshot % 100 - 1) * 7 as varchar) as o
from (select distinct snapshot from v_event_sn) w""")
def week_provenance(c: Catalogue):
    rows = tr.week_provenance(c.event_sn.select("snapshot").distinct())
    return rows.where(F.col("p").endswith("startedAtTime")).select("snapshot", "s", "p", "o")
