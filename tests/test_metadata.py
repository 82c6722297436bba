"""Mapping, resources and metrics on small documents with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from catascope.operators import access as ac
from catascope.operators import mapping as ma
from catascope.operators import quality as qu
from catascope.operators import reports as re
from catascope.operators import schema_org as so
from catascope.operators import triples as tr

API = "http://portal.org/api/"

CKAN = {
    "list_extras": {
        "id": "a", "name": "a-name", "title": " Title ", "notes": "text", "url": "http://x.org/a",
        "tags": [{"name": "t1"}, "t2"],
        "extras": [{"key": "language", "value": "de,en"}, {"key": "dcat_issued", "value": "2015-01-02"}],
        "maintainer": "M", "maintainer_email": "m@x.org", "organization": {"id": "o1", "title": "Org"},
        "license_id": "cc-by", "license_title": "CC", "license_url": "http://creativecommons.org/by",
        "spatial_uri": "http://geo.org/1", "temporal_end": "2016",
        "resources": [
            {"id": "r1", "name": "n", "url": "http://x.org/f.csv", "format": ".CSV", "mimetype": "text/csv", "size": "12", "created": "2015-05-05"},
            {"id": "r2", "url": "HTTP://X.org/f.csv", "format": "application/json", "license": "odc-by"},
            {"id": "r3", "url": "http://x.org/b", "download_url": "http://x.org/d", "size": "big"},
        ],
    },
    "map_extras": {"id": "b", "title": '{"label":"L"}', "extras": {"theme": '["x","y"]', "dcat_modified": "yesterday", "publisher_uri": "http://pub.org"}, "publisher_name": "P"},
    "bare": {"id": "c", "resources": [], "extras": []},
    "uri": {"uri": "http://own.org/d", "resources": [{"id": "r", "uri": "http://own.org/r", "url": "nourl"}]},
    "empty_key_hides_extras": {"id": "e", "title": "", "extras": [{"key": "title", "value": "hidden"}]},
}


def rows(spark, docs, software="CKAN"):
    data = [(k, k, "p", software, API, "http://portal.org/", "XX", 1601, json.dumps(d)) for k, d in docs.items()]
    df = spark.createDataFrame(data, "id string, md5 string, portalid string, software string, apiuri string, portal_uri string, iso string, snapshot int, raw string")
    return ma.MAPPINGS[software](df)


@pytest.fixture(scope="module")
def ckan(spark):
    return rows(spark, CKAN).cache()


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_ckan_dataset(ckan):
    got = by_id(ckan)
    a, b, c, u, e = (got[k] for k in ("list_extras", "map_extras", "bare", "uri", "empty_key_hides_extras"))
    assert a.uri == "http://portal.org/api/dataset/a" and u.uri == "http://own.org/d"
    assert a.title == ["Title"] and b.title == ["L"] and c.title == [] and e.title == []
    assert a.keywords == ["t1", "t2"] and a.language == ["de", "en"] and b.theme == ["x", "y"]
    assert a.issued == ["2015-01-02T00:00:00"] and b.modified == ["yesterday"]
    assert a.contact[0].fn == "M" and a.contact[0].email == "m@x.org" and a.contact[0].ref.startswith("_:")
    assert a.publisher[0].ref == "http://portal.org/api/organization/o1" and a.publisher[0].name == "Org"
    assert b.publisher[0].ref == "http://pub.org" and b.publisher[0].name == "P"
    assert a.spatial[0].ref == "http://geo.org/1" and a.temporal[0].end == "2016-01-01T00:00:00"
    assert c.contact == [] and c.distributions == []


def test_ckan_distributions(ckan):
    d1, d2, d3 = by_id(ckan)["list_extras"].distributions
    assert d1.ref == "http://portal.org/api/dataset/a/resource/r1" and d1.byte_size == ["12.0"] and d1.issued == ["2015-05-05T00:00:00"]
    assert d1.license[0].ref == "http://creativecommons.org/by" and d1.license[0].identifier == "cc-by"
    assert d1.format[0].label == ".CSV" and d1.media_type == ["text/csv"]
    assert d2.format == [] and d2.media_type == ["application/json"] and [x.ref for x in d2.license][1] == "odc-by"
    assert d3.access_url == ["http://x.org/b"] and d3.download_url == ["http://x.org/d"] and d3.byte_size == ["big"]
    assert by_id(ckan)["uri"].distributions[0].ref == "http://own.org/r"


def test_resources_keep_the_first_mention(ckan):
    got = {(r.md5, r.uri): r for r in ac.resources(ckan).collect()}
    assert set(got) == {
        ("list_extras", "http://x.org/f.csv"), ("list_extras", "http://x.org/b"), ("list_extras", "http://x.org/d"), ("uri", "nourl"),
    }
    first = got["list_extras", "http://x.org/f.csv"]
    assert (first.format, first.media, first.size, first.valid) == ("csv", "text/csv", 12, True)
    assert got["list_extras", "http://x.org/b"].size is None and got["uri", "nourl"].valid is False


def test_metrics_of_known_documents(ckan):
    q = by_id(qu.quality(ckan, keys=["id"]))
    a, c = q["list_extras"], q["bare"]
    assert a.exac and a.exco and abs(a.exdi - (1 + 1 + 1 + 1 + 0) / 5) < 1e-9
    assert abs(a.expr - (0 + 1 + 1 + 1) / 4) < 1e-9 and abs(a.exda - (1 + 0 + 1 + 0) / 4) < 1e-9
    assert (a.exri, a.exte, a.exsp) == (1.0, 1.0, 1.0)
    assert (a.coac, a.coce, a.cocu, a.coda, a.coli, a.opli) == (True, True, False, 1.0, True, True)
    assert (a.cofo, a.opfo, a.opma) == (1.0, 1.0, 1.0)
    assert (c.exac, c.exco, c.exdi, c.exri) == (False, False, 0.0, 0.0)
    assert all(c[m] is None for m in ("coac", "coce", "cocu", "coda", "cofo", "coli", "opfo", "opma", "opli"))
    assert q["map_extras"].coda == 0.0 and q["uri"].coac is False


def test_metrics_are_null_or_within_bounds(ckan):
    for r in qu.quality(ckan, extra=True).collect():
        assert all(v is None or 0 <= v <= 1 for k, v in r.asDict().items() if k != "md5")


def test_failing_metrics_include_unjudged_ones(ckan):
    failing = re.failing_metrics(qu.quality(ckan, keys=["id"]), ("id",)).collect()
    bare = {r.metric for r in failing if r.id == "bare"}
    assert bare == {code for code, *_ in re.HINTS} and "ExSp" not in bare
    assert {r.metric for r in failing if r.id == "list_extras"} == {"ExDi", "ExPr", "ExDa", "CoCU"}


def test_socrata(spark):
    rdf = (
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:dcat="http://www.w3.org/ns/dcat#" '
        'xmlns:dct="http://purl.org/dc/terms/" xmlns:ods="urn:ods#"><dcat:Dataset><dct:title>T10</dct:title><dct:identifier>x-10</dct:identifier><dcat:keyword>k0</dcat:keyword>'
        '<dcat:keyword>k1</dcat:keyword><ods:created>2015-01-10</ods:created><dcat:distribution><dcat:Download><dcat:accessURL rdf:resource="http://x.org/1"/>'
        "<dct:format><rdf:Description><rdfs:label>CSV</rdfs:label><rdf:value>text/csv</rdf:value></rdf:Description></dct:format></dcat:Download></dcat:distribution></dcat:Dataset></rdf:RDF>"
    )
    docs = {"full": {"view": {"id": "x-10", "owner": {"displayName": "O"}, "tableAuthor": {"displayName": "A"}}, "dcat": rdf}, "none": {"view": {"id": "y"}, "dcat": None}}
    got = by_id(rows(spark, docs, "Socrata"))
    f = got["full"]
    assert f.uri == "http://portal.org/api/dataset/x-10" and f.title == ["T10"] and f.keywords == ["k0", "k1"] and f.issued == ["2015-01-10T00:00:00"]
    assert f.publisher[0].name == "O" and f.contact[0].fn == "A"
    d = f.distributions[0]
    assert d.access_url == ["http://x.org/1"] and d.format[0].label == "CSV" and d.media_type == ["text/csv"]
    assert got["none"].title == [] and got["none"].distributions == [] and got["none"].publisher == []


def test_opendatasoft(spark):
    docs = {
        "geo": {"datasetid": "g", "has_records": True, "features": ["geo"], "metas": {"title": "T", "keyword": ["a", "b"], "license": "L", "publisher": "P", "references": "http://r.org", "modified": "2016-01-01"},
                "attachments": [{"id": "att", "title": "A", "mimetype": "application/pdf", "format": "pdf"}]},
        "plain": {"datasetid": "h", "has_records": True, "metas": {}},
        "nothing": {"datasetid": "i", "has_records": False, "metas": {}},
    }
    got = by_id(rows(spark, docs, "OpenDataSoft"))
    g = got["geo"]
    assert len(g.distributions) == 6 and len(got["plain"].distributions) == 3 and got["nothing"].distributions == []
    assert g.distributions[0].access_url == ["http://portal.org/api/api/records/1.0/download?dataset=g&format=csv"]
    assert g.distributions[5].access_url == ["http://portal.org/api/api/datasets/1.0/g/attachments/att"] and g.distributions[5].license[0].label == "L"
    assert g.keywords == ["a", "b"] and g.see_also == ["http://r.org"] and g.publisher[0].name == "P"


def test_data_gouv_fr(spark):
    docs = {"x": {"id": "x", "page": "http://gouv/x", "title": "T", "tags": ["t10", "t20"], "created_at": "2015-01-01", "license": "fr-lo",
                  "organization": {"id": "o", "name": "O"}, "resources": [{"id": "r", "url": " http://u ", "format": "csv", "mime": "text/csv", "filesize": 10}]}}
    x = by_id(rows(spark, docs, "DataGouvFr"))["x"]
    assert x.uri == "http://gouv/x" and x.keywords == ["t10", "t20"] and x.publisher[0].name == "O" and x.landing_page == ["http://gouv/x"]
    d = x.distributions[0]
    assert d.download_url == ["http://u"] and d.byte_size == ["10.0"] and d.license[0].identifier == "fr-lo"


def test_json_ld(spark):
    nodes = [
        {"@id": "http://d", "@type": [ma.DCAT + "Dataset"], ma.DCT + "title": [{"@value": " T "}], ma.DCT + "publisher": [{"@id": "_:o"}], ma.DCAT + "distribution": [{"@id": "_:r"}]},
        {"@id": "_:o", "@type": [ma.FOAF + "Organization"], ma.FOAF + "name": [{"@value": "O"}]},
        {"@id": "_:r", "@type": [ma.DCAT + "Distribution"], ma.DCAT + "accessURL": [{"@id": "http://u"}], ma.DCT + "format": [{"@value": "csv"}], ma.DCT + "license": [{"@id": "http://lic"}]},
    ]
    d = by_id(rows(spark, {"d": nodes}, "XMLDCAT").withColumn("formats", ac.distribution_formats()))["d"]
    assert d.uri == "http://d" and d.title == ["T"] and d.publisher[0].name == "O"
    assert d.distributions[0].access_url == ["http://u"] and d.distributions[0].license[0].ref == "http://lic" and d.formats == ["csv"]


def test_triples_and_lines(ckan):
    t = tr.dcat_triples(ckan.where("id = 'list_extras'"), ["portalid"]).collect()
    assert len({(r.s, r.p, r.o) for r in t}) == len(t)
    assert sum(r.p == ma.DCAT + "distribution" for r in t) == 3
    kinds = {r.o_kind for r in t}
    assert kinds == {"uri", "literal", "bnode"}
    lines = [r.value for r in tr.n_triples(tr.dcat_triples(ckan)).collect()]
    assert all(line.endswith(" .") and line[0] in "<_" for line in lines)


def test_schema_org_document(ckan):
    doc = json.loads(so.schema_org(ckan.where("id = 'list_extras'"), ["id"]).first().doc)
    assert doc["@type"] == "Dataset" and doc["name"] == "Title" and doc["url"] == "http://x.org/a" and doc["catalog"]["spatialCoverage"] == "XX"
    assert doc["publisher"] == {"@type": "Organization", "@id": "http://portal.org/api/organization/o1", "name": "Org", "email": "m@x.org"}
    assert [d["contentUrl"] for d in doc["distribution"]] == ["http://x.org/f.csv", "HTTP://X.org/f.csv", "http://x.org/b"]


def test_organisation_falls_back_to_the_contact(ckan):
    got = {r.id: r.organisation for r in ckan.select("id", ac.organisation().alias("organisation")).collect()}
    assert got["list_extras"] == "Org" and got["map_extras"] == "P" and got["bare"] is None


def test_portal_quality_counts_only_judged(spark):
    scores = spark.createDataFrame([("a", True, 0.25), ("b", None, 0.75), ("c", False, None)], "md5 string, coac boolean, exda double")
    for m in qu.PORTAL_METRICS:
        if m not in scores.columns:
            scores = scores.withColumn(m, F.lit(None).cast("boolean" if m in qu.BOOLEAN_METRICS else "double"))
    ds = spark.createDataFrame([("p", 1, "a"), ("p", 1, "a"), ("p", 1, "b"), ("p", 1, "c")], "portalid string, snapshot int, md5 string")
    r = qu.portal_quality(ds, scores).first()
    assert (r.datasets, r.coac, r.coacN, r.exda, r.exdaN, r.opfo, r.opfoN) == (4, 0.67, 3, 0.42, 3, None, 0)


def test_nodes_of_documents_are_dealt_once(spark):
    from catascope.operators import triples as tr

    rows = [("a", "urn:s", "urn:p", "2", "literal", None), ("a", "urn:s", "urn:p", "1", "literal", None), ("a", "urn:s", "urn:q", "urn:o", "uri", None), ("b", "urn:s", "urn:p", "1", "literal", None)]
    nodes = tr.json_ld_nodes(spark.createDataFrame(rows, "md5 string, s string, p string, o string, o_kind string, o_type string"), ["md5"])
    assert nodes._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {(r.md5, r.node) for r in nodes.collect()} == {
        ("a", '{"@id":"urn:s","urn:p":[{"@value":"1"},{"@value":"2"}],"urn:q":[{"@id":"urn:o"}]}'), ("b", '{"@id":"urn:s","urn:p":[{"@value":"1"}]}'),
    }
