"""Catalogues as graphs: the parser, what is reached, hashes of graphs, trees."""

import json

import pytest
from pyspark.sql import functions as F

from catascope.functions import rdfxml
from catascope.operators import graphs as gr
from catascope.operators import mapping as ma
from catascope.sources import harvest as ha
from catascope.sources import sinks

HEAD = (
    '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dcat="http://www.w3.org/ns/dcat#" xmlns:dct="http://purl.org/dc/terms/" '
    'xmlns:foaf="http://xmlns.com/foaf/0.1/" xmlns:ex="urn:ex#">'
)
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def parse(body, **options):
    return list(rdfxml.triples((HEAD + body + "</rdf:RDF>").encode(), "f", **options))


def test_forms_of_the_syntax():
    got = parse(
        '<rdf:Description rdf:about="urn:a" ex:short="s" xml:lang="de"><ex:p>text</ex:p><ex:q rdf:datatype="urn:t"> 7 </ex:q><ex:r rdf:resource="urn:b"/>'
        '<ex:n rdf:nodeID="n1"/><ex:in><ex:Kind rdf:nodeID="n2"><ex:p xml:lang="en">deep</ex:p></ex:Kind></ex:in></rdf:Description>'
    )
    a = "urn:a"
    assert set(got) == {
        (a, "urn:ex#short", "s", "literal", None, "de"), (a, "urn:ex#p", "text", "literal", None, "de"), (a, "urn:ex#q", " 7 ", "literal", "urn:t", None),
        (a, "urn:ex#r", "urn:b", "uri", None, None), (a, "urn:ex#n", "_:fnn1", "bnode", None, None), (a, "urn:ex#in", "_:fnn2", "bnode", None, None),
        ("_:fnn2", RDF + "type", "urn:ex#Kind", "uri", None, None), ("_:fnn2", "urn:ex#p", "deep", "literal", None, "en"),
    }


def test_shorter_forms_of_the_syntax():
    got = parse('<ex:A rdf:ID="x"><ex:r rdf:parseType="Resource"><ex:p>v</ex:p></ex:r><ex:c ex:p="w"/><ex:li2 rdf:parseType="Literal">a<b>c</b></ex:li2></ex:A>', base="http://h/d")
    subject = {t[1]: t for t in got if t[0] == "http://h/d#x"}
    inner, cell = subject["urn:ex#r"][2], subject["urn:ex#c"][2]
    assert (inner, "urn:ex#p", "v", "literal", None, None) in got and (cell, "urn:ex#p", "w", "literal", None, None) in got
    assert subject["urn:ex#li2"][2].startswith("a<b>c</b>") and subject["urn:ex#li2"][4] == RDF + "XMLLiteral"
    items = parse('<rdf:Seq rdf:about="s"><rdf:li>1</rdf:li><rdf:li>2</rdf:li></rdf:Seq><ex:L rdf:about="l"><ex:c rdf:parseType="Collection"><ex:I rdf:about="i1"/><ex:I rdf:about="i2"/></ex:c></ex:L>', base="http://h/")
    assert ("http://h/s", RDF + "_2", "2", "literal", None, None) in items
    firsts = [t[2] for t in items if t[1] == RDF + "first"]
    assert firsts == ["http://h/i1", "http://h/i2"] and items[-1][1] != RDF + "rest" and any(t[2] == RDF + "nil" for t in items)


@pytest.fixture
def catalogue(spark, tmp_path):
    def write(files, snapshot=2401, portal="p"):
        folder = tmp_path / "c" / f"portalid={portal}" / f"snapshot={snapshot}"
        folder.mkdir(parents=True, exist_ok=True)
        for name, body in files.items():
            (folder / name).write_text(HEAD + body + "</rdf:RDF>" if body is not None else HEAD + "<dcat:Dataset><dct:title>cut")
        return ha.read_xml_catalogue(spark, str(tmp_path / "c"))

    return write


def dataset(name, *more):
    return f'<dcat:Dataset rdf:about="urn:{name}"><dct:identifier>{name}</dct:identifier>{"".join(more)}</dcat:Dataset>'


def test_everything_that_is_reached_and_nothing_else(spark, catalogue):
    rows = catalogue({
        "a.xml": dataset("a", '<dct:publisher rdf:resource="urn:org"/><ex:x rdf:nodeID="q"/>') + '<ex:T rdf:nodeID="q"><ex:y rdf:resource="urn:z"/></ex:T>',
        "b.xml": '<foaf:Organization rdf:about="urn:org"><foaf:name>Office</foaf:name><ex:head rdf:resource="urn:a"/></foaf:Organization>'
        '<ex:Z rdf:about="urn:z"><ex:deep>3</ex:deep></ex:Z><ex:Z rdf:about="urn:other"><ex:deep>4</ex:deep></ex:Z>' + dataset("lone"),
        "bad.xml": None,
    })
    assert [r.file.split("/")[-1] for r in gr.rejected_files(rows).collect()] == ["bad.xml"]
    docs = {r.id: json.loads(r.raw) for r in gr.documents(rows).collect()}
    assert set(docs) == {"a", "lone"} and len(docs["lone"]) == 1
    nodes = {n["@id"]: n for n in docs["a"]}
    assert nodes["urn:org"]["http://xmlns.com/foaf/0.1/name"] == [{"@value": "Office"}]
    assert nodes["urn:z"]["urn:ex#deep"] == [{"@value": "3"}] and len(nodes) == 4 and "urn:other" not in nodes
    mapped = ma.json_ld(gr.documents(rows).where("id = 'a'").withColumn("apiuri", F.lit(""))).first()
    assert mapped.publisher[0].name == "Office"
    triples = gr.document_triples(gr.documents(rows), ["id"]).where("p = 'urn:ex#deep'").collect()
    assert [(t.id, t.s, t.o) for t in triples] == [("a", "urn:z", "3")]


def test_hash_of_a_graph_does_not_depend_on_names_and_order(spark, catalogue):
    def body(names, turned=False, extra=""):
        a, b, c = names
        nodes = [
            f'<ex:N rdf:nodeID="{a}"><ex:v>1</ex:v><ex:next rdf:nodeID="{b}"/></ex:N>',
            f'<ex:N rdf:nodeID="{b}"><ex:v>1</ex:v><ex:next rdf:nodeID="{a}"/></ex:N>',  # a cycle
            f'<ex:N rdf:nodeID="{c}"><ex:v>2</ex:v>{extra}</ex:N>',
            dataset("a", f'<ex:n rdf:nodeID="{a}"/>', f'<ex:m rdf:nodeID="{c}"/>', f'<ex:m2><ex:N><ex:v>2</ex:v></ex:N></ex:m2>'),
        ]
        return "".join(reversed(nodes) if turned else nodes)

    catalogue({"a.xml": body("xyz")}, 2401)
    catalogue({"other.xml": body("zxy", True)}, 2402)
    catalogue({"a.xml": body("xyz", extra="<ex:more>3</ex:more>")}, 2403)
    rows = catalogue({"a.xml": body("xyz").replace('nodeID="x"/></ex:N>', 'nodeID="y"/></ex:N>')}, 2404)
    parts = gr.datasets(rows).drop("depth")
    found = {r.snapshot: r.hash for r in gr.graph_hash(parts, [*gr.RUN, "root"]).collect()}
    assert found[2401] == found[2402] and len(set(found.values())) == 3
    raw = {r.snapshot: r.raw for r in gr.documents(rows).collect()}
    assert raw[2401] == raw[2402] != raw[2403]


def test_id_without_identifier_and_two_datasets_of_one_id(spark, catalogue):
    rows = catalogue({"a.xml": "<dcat:Dataset><dct:title>x</dct:title></dcat:Dataset>" + dataset("k", "<ex:v>1</ex:v>") + dataset("k2").replace(">k2<", ">k<")})
    docs = {r.id: json.loads(r.raw) for r in gr.documents(rows).collect()}
    assert len(docs) == 2 and docs["k"][0]["@id"] == "urn:k" and len([i for i in docs if i != "k"][0]) == 40
    again = catalogue({"a.xml": "<ex:Noise/><dcat:Dataset><dct:title>x</dct:title></dcat:Dataset>"}, portal="q")
    assert {r.id for r in gr.documents(again).where("portalid = 'q'").collect()} == {i for i in docs if i != "k"}
    assert gr.documents(again.limit(0)).count() == 0


def test_trees_have_every_node_once_and_no_cycle(spark, tmp_path):
    rows = [
        ("p", "d", "urn:d", gr.TYPE, ma.DCAT + "Dataset", "uri"), ("p", "d", "urn:d", "urn:a", "_:x", "bnode"), ("p", "d", "urn:d", "urn:b", "_:y", "bnode"),
        ("p", "d", "_:x", "urn:c", "_:y", "bnode"), ("p", "d", "_:y", "urn:back", "urn:d", "uri"), ("p", "d", "_:y", "urn:t", 'te"xt', "literal"),
        ("p", "d", "_:x", "urn:same", "urn:nowhere", "uri"), ("p", "d", "_:lost", "urn:t", "never", "literal"),
    ]
    triples = spark.createDataFrame([(*r, None) for r in rows], "portalid string, md5 string, s string, p string, o string, o_kind string, o_type string")
    sinks.write_json_ld(triples, str(tmp_path / "out"))
    text = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(text) == 1
    assert json.loads(text[0]) == {
        "@id": "urn:d", "@type": [ma.DCAT + "Dataset"],
        "urn:a": [{"@id": "_:x", "urn:c": [{"@id": "_:y"}], "urn:same": [{"@id": "urn:nowhere"}]}],
        "urn:b": [{"@id": "_:y", "urn:back": [{"@id": "urn:d"}], "urn:t": [{"@value": 'te"xt'}]}],
    }
    docs = spark.createDataFrame([("d", text[0]), ("e", "no json"), ("f", '{"@graph":[{"@id":"urn:f","urn:p":["x",{"@value":"y","@language":"de"},{"@list":[{"@id":"urn:g"},{"urn:q":"z"}]}]}]}')], "id string, raw string")
    got = {(r.id, r.s, r.p, r.o, r.o_kind) for r in gr.document_triples(docs, ["id"]).collect()}
    assert {("d", *r[2:]) for r in rows if r[2] != "_:lost"} == {t for t in got if t[0] == "d"}
    f = {t[2:] for t in got if t[0] == "f"}
    assert ("urn:p", "x", "literal") in f and ("urn:p", "y", "literal") in f and ("urn:p", "urn:g", "uri") in f and ("urn:q", "z", "literal") in f and len(f) == 5


def test_many_datasets_of_one_publisher(spark, catalogue):
    body = "".join(dataset(f"d{i}", '<dct:publisher rdf:resource="urn:org"/>') for i in range(300))
    rows = catalogue({"a.xml": body + '<foaf:Organization rdf:about="urn:org"><foaf:name>Office</foaf:name></foaf:Organization>'})
    docs = gr.documents(rows).collect()
    assert len(docs) == 300 and all("Office" in r.raw for r in docs)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_hashes_and_trees_deal_their_triples_once(spark):
    rows = [("p", "d", "urn:d", gr.TYPE, ma.DCAT + "Dataset", "uri", None, None), ("p", "d", "urn:d", "urn:a", "_:x", "bnode", None, None), ("p", "d", "_:x", "urn:t", "v", "literal", None, "de")]
    graph = spark.createDataFrame(rows, "portalid string, md5 string, s string, p string, o string, o_kind string, o_type string, o_lang string")
    roots = spark.createDataFrame([("p", "d", "urn:d"), ("p", "d", "urn:none")], "portalid string, md5 string, root string")
    tree = gr.trees(graph, roots, ["portalid", "md5"])
    assert exchanges(tree) == 1 and exchanges(gr.graph_hash(graph, ["portalid", "md5"])) == 1
    assert [(r.root, json.loads(r.value)["urn:a"]) for r in tree.collect()] == [("urn:d", [{"@id": "_:x", "urn:t": [{"@value": "v", "@language": "de"}]}])]


def test_triples_that_come_again_in_files_count_once(spark, catalogue):
    org = '<foaf:Organization rdf:about="urn:org"><foaf:name>Office</foaf:name></foaf:Organization>'
    link = '<dct:publisher rdf:resource="urn:org"/>'
    rows = catalogue({"a.xml": dataset("a", link) + org * 3, "b.xml": dataset("b", link) + org})
    assert rows.where("o = 'Office'").count() == 2  # one per file
    docs = {r.id: json.loads(r.raw) for r in gr.documents(rows).collect()}
    assert all([n["http://xmlns.com/foaf/0.1/name"] for n in d if n["@id"] == "urn:org"] == [[{"@value": "Office"}]] for d in docs.values()) and len(docs) == 2


def test_json_texts_are_as_spark_writes_them(spark):
    texts = [chr(i) for i in range(0x20)] + ['a"b\\c/d', "\\u0001", "\x7f\x85 ü😀", "", "\\\x1f\\u001f"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", F.to_json(F.struct("v")).alias("j")).collect()
    assert all(r.j == '{"v":' + gr._quoted(r.v) + "}" for r in rows)


def test_socrata_records_are_looked_up_in_their_rows(spark):
    xml = HEAD[:-1] + ' xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#"><dcat:Dataset rdf:about="urn:v"><dct:identifier>v1</dct:identifier><dcat:distribution><dcat:Download rdf:about="urn:f"><dct:format>'
    xml += '<rdf:Description rdf:about="urn:k"><rdfs:label>CSV</rdfs:label><rdf:value>text/csv</rdf:value></rdf:Description></dct:format></dcat:Download></dcat:distribution></dcat:Dataset></rdf:RDF>'
    raw = json.dumps({"view": {"id": "v1", "owner": {"displayName": "Office"}}, "dcat": xml})
    records = spark.createDataFrame([("p", "m", "http://h/api/", raw), ("p", "m", "http://h/api/", raw), ("p", "n", "http://h/api/", "{}")], "portalid string, md5 string, apiuri string, raw string")
    graph = gr.socrata_triples(records, ["portalid", "md5"])
    assert exchanges(graph) == 1
    rows = {(r.s, r.p, r.o, r.o_kind) for r in graph.collect()}
    uri = "http://h/api/dataset/v1"
    dist = next(o for s, p, o, kind in rows if p == ma.DCAT + "distribution" and (s, kind) == (uri, "bnode"))
    assert {(dist, ma.DCAT + "mediaType", "text/csv", "literal"), (dist, gr.TYPE, ma.DCAT + "Distribution", "uri"), ("CSV", gr.TYPE, ma.DCT + "MediaTypeOrExtent", "uri"), (uri, gr.TYPE, ma.DCAT + "Dataset", "uri")} <= rows
    assert not any(p == ma.DCT + "format" or o.endswith("Download") or s == "urn:f" for s, p, o, _ in rows) and any(o == "Office" for _, _, o, _ in rows)
