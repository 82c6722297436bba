"""Catalogues as graphs: triples of files, what a dataset reaches, documents, hashes and trees.

A graph is rows of (keys, s, p, o, o_kind, o_type, o_lang); keys say which graph a triple is in. What
datasets reach in a catalogue is found in rounds of joins over all catalogues at once, each round written
to the shared folder; the number of rounds follows the depth of the graphs only. What becomes one
text (a hash, a document, a tree) is dealt by its graph once and put together there.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, groupby
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from catascope.functions import documents as doc
from catascope.functions import rdfxml
from catascope.functions.ratios import angle, node_id
from catascope.functions.text import filled
from catascope.operators.mapping import DCAT, DCT, FOAF, RDF, RDFS, VCARD
from catascope.session import ship, staged

RUN = ["portalid", "snapshot"]
TERMS = ["s", "p", "o", "o_kind", "o_type", "o_lang"]
TYPE = RDF + "type"
ODS = "http://open-data-standards.github.com/2012/01/open-data-standards#"
#: Triples that a task gives out at once, and letters of texts.
BATCH, LETTERS = 4096, 4_000_000


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _parsed(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Files (portalid, snapshot, file, content) to their triples, each once per BATCH; a file that breaks gives a
    last row with the reason as `error`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *head, content in zip(*batch.columns):
                head, rows = [v.as_py() for v in head], {}
                blank = hashlib.sha1(head[-1].encode()).hexdigest()[:12]
                try:
                    for t in rdfxml.triples(content.as_py() or b"", blank):
                        rows[(*head, *t, None)] = None
                        if len(rows) == BATCH:
                            yield _batch([*rows], schema)
                            rows = {}
                except rdfxml.ET.ParseError as e:
                    rows[(*head, *[None] * len(TERMS), str(e))] = None
                if rows:
                    yield _batch([*rows], schema)

    return run


def read_catalogues(spark: SparkSession, path: str) -> DataFrame:
    """Triples (portalid, snapshot, file, s, p, o, o_kind, o_type, o_lang, error) of RDF/XML files below
    portalid=/snapshot= folders; what a file repeats may come once.

    A file is one response of a portal and is read by one task, piece by piece; blank nodes are its own.
    """
    files = spark.read.format("binaryFile").load(path)
    files = files.select("portalid", F.col("snapshot").cast("int").alias("snapshot"), "path", "content")
    schema = T.StructType([*files.schema[:2], *_struct(*[f"{c} string" for c in ("file", *TERMS, "error")])])
    return files.mapInArrow(_parsed(to_arrow_schema(schema)), schema)


def _struct(*fields: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(fields))


def by_group(rows: DataFrame, keys: list[str], work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """(keys, schema): what `work` makes of each group's other columns. A group is held by one task, so it has to be
    no larger than the text that comes out of it."""
    full = T.StructType([*rows.select(*keys).schema, *_struct(schema)])
    arrow, n = to_arrow_schema(full), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, letters = [], 0
        every = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        for key, group in groupby(every, lambda r: r[:n]):
            for row in work([r[n:] for r in group]):
                out.append((*key, *row))
                letters += sum(len(v) for v in row if isinstance(v, str))
            if letters > LETTERS or len(out) >= BATCH:
                yield _batch(out, arrow)
                out, letters = [], 0
        if out:
            yield _batch(out, arrow)

    others = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, full)


def rejected_files(catalogues: DataFrame) -> DataFrame:
    """Files that are no well-formed XML, with the reason; what stands before the break is kept."""
    return catalogues.where("error is not null").select(*RUN, "file", "error")


def graph_of(catalogues: DataFrame) -> DataFrame:
    """One graph per portal and snapshot: the files' triples, in which some may come again."""
    return staged(catalogues.where("error is null").select(*RUN, *TERMS), "graph")


def _at(keys: list[str], node: str) -> Column:
    """A short name of a node of a graph, null where a key is: 16 bytes for (keys, node)."""
    texts = [F.col(c).cast("string") for c in (*keys, node)]
    return F.unhex(F.md5(F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(" "), t)])))


def of_type(graph: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, root): the subjects of a type."""
    return graph.where((F.col("p") == TYPE) & (F.col("o") == kind)).select(*keys, F.col("s").alias("root")).distinct()


def reachable(graph: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, root, at, depth): every subject (by `_at`) that links lead to from a root, by the shortest way.

    One round of joins per step of depth; a node is taken up once per root, so cycles end. Rounds move
    short names only.
    """
    subjects = graph.select(_at(keys, "s").alias("next")).distinct()
    edges = graph.where("o_kind <> 'literal'").select(_at(keys, "s").alias("at"), _at(keys, "o").alias("next"))
    edges = staged(edges.join(subjects, "next", "left_semi").distinct(), "edges")
    roots = staged(roots.select(*keys, "root", _at(keys, "root").alias("from")), "roots")
    found = [staged(roots.select("from", F.col("from").alias("at"), F.lit(0).alias("depth")).distinct(), "reached")]
    while True:
        step = found[-1].join(edges, "at").select("from", F.col("next").alias("at"), (F.col("depth") + 1).alias("depth")).distinct()
        before = reduce(DataFrame.unionByName, found).select("from", "at")
        step = staged(step.join(before, ["from", "at"], "left_anti"), "reached")
        if step.isEmpty():
            return reduce(DataFrame.unionByName, found).join(roots, "from").select(*keys, "root", "at", "depth")
        found.append(step)


def subgraphs(graph: DataFrame, reached: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, root, depth, triples): the part of the graph that each root reaches, each triple once."""
    rows = graph.withColumn("at", _at(keys, "s")).repartition("at").distinct()  # dealt once, for distinct() and the join
    return staged(reached.select("at", "root", "depth").join(rows, "at").select(*keys, "root", "depth", *TERMS), "subgraphs")


def _text(o: str, kind: str, o_type: str | None, lang: str | None) -> str:
    """A term that is no blank node, told apart from all others."""
    if kind != "literal":
        return "u" + o
    return " ".join(["l", *(mark + part for mark, part in (("^", o_type), ("@", lang)) if part is not None), "=" + o])


def _digest(lines: list[str]) -> str:
    return hashlib.sha1("\n".join(sorted(lines)).encode()).hexdigest()


def colours(triples: list[tuple]) -> dict[str, str]:
    """A colour for each blank node of a graph that depends on what it says and not on its name.

    A node whose objects all have colours gets the hash of its properties, so colours rise from the
    leaves, one round per level. Nodes on cycles, or above them, are refined from one common colour,
    also by what leads to them, until the number of colours does not grow.
    """
    rows: dict[str, list] = defaultdict(list)  # (predicate, object, its text if known)
    blank = {t[0] for t in triples if t[0].startswith("_:")}
    for s, p, o, kind, o_type, lang in triples:
        if s in blank:
            rows[s].append((p, o, None if o in blank else "b" if kind == "bnode" else _text(o, kind, o_type, lang)))
    done: dict[str, str] = {}
    line = lambda p, o, term, known: f"{p} {term if term is not None else 'c' + known[o]}"
    while ready := [n for n in blank if n not in done and all(term is not None or o in done for _, o, term in rows[n])]:
        done |= {n: _digest([line(*r, done) for r in rows[n]]) for n in ready}
    left = {n: "x" for n in blank if n not in done}
    for s, p, o, kind, *_ in triples:
        if kind == "bnode" and o in left:
            rows[o].append(("<" + p, s, None if s.startswith("_:") else "u" + s))
    kinds, now = 0, min(1, len(left))
    while now > kinds:
        known = done | left
        left = {n: _digest([line(*r, known) for r in rows[n]]) for n in left}
        kinds, now = now, len(set(left.values()))
    return done | left


def _names(colour: dict[str, str]) -> dict[str, str]:
    """Blank nodes named by their colours, equal ones numbered by their names."""
    out, nr = {}, defaultdict(int)
    for node in sorted(colour):
        nr[colour[node]] += 1
        out[node] = f"_:{colour[node]}" + (f"-{nr[colour[node]]}" if nr[colour[node]] > 1 else "")
    return out


def _hash(triples: list[tuple], colour: dict[str, str]) -> str:
    lines = []
    for s, p, o, kind, o_type, lang in triples:
        # a literal may look like a blank node
        end = _text(o, kind, o_type, lang) if kind != "bnode" else "c" + colour[o] if o in colour else "b"
        lines.append(f"{'c' + colour[s] if s in colour else 'u' + s} {p} {end}")
    return _digest(lines)


def graph_hash(graph: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hash): the same for graphs that differ in the order of triples and the names of blank nodes only."""
    return by_group(graph.select(*keys, *TERMS), keys, lambda rows: [(_hash(rows, colours(rows)),)], "hash string")


#: How JSON writes letters that it cannot have as they are, where that is not as Python's does.
ESCAPES = {i: f"\\u{i:04X}" for i in range(32)} | {ord(c): "\\" + e for c, e in zip('"\\\b\t\n\f\r', '"\\btnfr')}


def _quoted(text: str) -> str:
    out = encode_basestring(text)
    return out if "\\u" not in out else f'"{text.translate(ESCAPES)}"'


def _value(p: str, o: str, kind: str, o_type: str | None, lang: str | None) -> str:
    """An object as JSON-LD, outside of types."""
    if kind != "literal":
        return '{"@id":' + _quoted(o) + "}"
    return "{" + ",".join(f'"{k}":{_quoted(v)}' for k, v in (("@value", o), ("@type", o_type), ("@language", lang)) if v is not None) + "}"


def _node(s: str, props: dict[str, list[str]]) -> str:
    """JSON text of a subject with the texts of its objects by predicate."""
    pairs = sorted(f'{_quoted("@type" if p == TYPE else p)}:[{",".join(sorted(v))}]' for p, v in props.items())
    return f'{{"@id":{_quoted(s)},{",".join(pairs)}}}'


def _document(triples: list[tuple]) -> list[tuple]:
    """(hash, own, raw) of a dataset from its triples, each with an identifier if it gives one."""
    own = min((t[-1] for t in triples if t[-1] is not None), default=None)
    triples = [t[:-1] for t in triples]
    colour = colours(triples)
    names = _names(colour)
    nodes: dict[str, dict] = defaultdict(lambda: defaultdict(list))
    for s, p, o, kind, *more in triples:
        o = names.get(o, o) if kind == "bnode" else o
        nodes[names.get(s, s)][p].append(_quoted(o) if p == TYPE else _value(p, o, kind, *more))
    return [(_hash(triples, colour), own, "[" + ",".join(sorted(_node(s, props) for s, props in nodes.items())) + "]")]


def datasets(catalogues: DataFrame) -> DataFrame:
    """(portalid, snapshot, root, depth, triples): what each dataset of the catalogues reaches."""
    graph = graph_of(catalogues)
    return subgraphs(graph, reachable(graph, of_type(graph, RUN, DCAT + "Dataset"), RUN), RUN)


def _identifier() -> Column:
    """The identifier that a triple gives its dataset, or null."""
    given = (F.col("s") == F.col("root")) & (F.col("p") == DCT + "identifier") & (F.col("o_kind") == "literal") & filled(F.trim("o"))
    return F.when(given, F.trim("o"))


def identifiers(parts: DataFrame) -> DataFrame:
    """(portalid, snapshot, root, own): a dataset's first identifier by text."""
    return parts.where(_identifier().isNotNull()).groupBy(*RUN, "root").agg(F.min(F.trim("o")).alias("own"))


def documents(catalogues: DataFrame) -> DataFrame:
    """(portalid, snapshot, id, raw): a JSON-LD document per dataset with everything that it reaches.

    Nodes are listed by name, blank ones named by what they say, so that the text does not depend on
    the order of a file. The id is the first identifier by text, else the hash of the graph; of
    datasets with one id the first by address is kept. Only of ids that come again are addresses compared.
    """
    keys = [*RUN, "root"]
    parts = datasets(catalogues).select(*keys, *TERMS, _identifier().alias("own"))
    docs = by_group(parts, keys, _document, "hash string, own string, raw string")
    docs = staged(docs.select(*keys, F.coalesce("own", "hash").alias("id"), "raw"), "documents")
    again = docs.groupBy(*RUN, "id").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("first")).where("n > 1").drop("n")
    docs = docs.join(staged(again, "repeated-ids"), [*RUN, "id"], "left")
    return docs.where("first is null or root = first").select(*RUN, "id", "raw")


def document_triples(records: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """All triples of JSON-LD documents, whatever their predicates: (keys, s, p, o, o_kind, o_type, o_lang).

    A document is a node, a list of nodes or has them as `@graph`; terms are full addresses. Nodes
    inside of nodes are taken out in rounds, one per level; those without a name get one from their
    place. A text that is no JSON has no triples.
    """
    doc_ = F.try_parse_json(raw)
    listed = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    nodes = records.select(*keys, F.posexplode(listed(F.coalesce(F.try_variant_get(doc_, "$['@graph']", "variant"), doc_))).alias("pos", "v"))
    nodes = nodes.withColumn("m", fields(F.col("v"))).where("m is not null")
    name = F.coalesce(doc.get(F.col("v"), "@id"), F.concat(F.lit("_:"), F.sha1(F.concat(F.lit("node"), F.col("pos").cast("string")))))
    nodes = nodes.select(*keys, F.trim(name).alias("s"), "m")
    found = []
    while True:
        values = nodes.select(*keys, "s", F.explode("m").alias("p", "v")).where("p not in ('@id', '@context')")
        values = values.select(*keys, "s", "p", F.posexplode(listed(F.col("v"))).alias("pos", "v"))
        lists = F.try_variant_get("v", "$['@list']", "array<variant>")
        values = values.select(*keys, "s", "p", "pos", F.posexplode(F.coalesce(lists, F.array("v"))).alias("pos2", "v"))
        values = values.withColumn("m", fields(F.col("v")))
        literal = F.coalesce(F.map_contains_key("m", "@value"), F.lit(False))
        node = F.col("m").isNotNull() & ~literal
        place = F.concat_ws(" ", "s", "p", F.col("pos").cast("string"), F.col("pos2").cast("string"))
        ref = F.trim(F.coalesce(doc.get(F.col("v"), "@id"), F.concat(F.lit("_:"), F.sha1(place))))
        plain = F.try_variant_get("v", "$", "string")
        of_type_ = F.col("p") == "@type"
        o = F.when(of_type_, plain).when(literal, doc.get(F.col("v"), "@value")).when(node, ref).otherwise(plain)
        kind = F.when(of_type_, "uri").when(node, F.when(ref.startswith("_:"), "bnode").otherwise("uri")).otherwise("literal")
        values = values.select(
            *keys, "s", F.when(of_type_, TYPE).otherwise(F.col("p")).alias("p"), o.alias("o"), kind.alias("o_kind"),
            F.when(literal, doc.get(F.col("v"), "@type")).alias("o_type"), F.when(literal, doc.get(F.col("v"), "@language")).alias("o_lang"),
            F.when(node & ~of_type_, F.to_json("v")).alias("inner"),
        )
        values = staged(values.where("o is not null"), "json-triples")
        found.append(values.drop("inner"))
        inside = values.where("inner is not null").withColumn("m", fields(F.try_parse_json("inner")))
        inside = inside.where(F.size(F.array_except(F.map_keys("m"), F.array(F.lit("@id")))) > 0)
        if inside.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        nodes = inside.select(*keys, F.col("o").alias("s"), "m")


def _trees(rows: list[tuple]) -> list[tuple]:
    """(root, value) for each root of a graph; roots are rows without a predicate."""
    triples: dict[str, list] = defaultdict(list)
    for s, *rest in rows:
        if rest[0] is not None:
            triples[s].append(rest)
    return [(root, _tree(triples, root)) for root, p, *_ in rows if p is None and root in triples]


def _tree(triples: dict[str, list], root: str) -> str:
    depth, level = {root: 0}, [root]
    holder: dict[str, tuple] = {}
    while level:
        below: dict[str, int] = {}
        for s in level:
            for p, o, kind, *_ in triples[s]:
                if kind != "literal" and o in triples and o not in depth:
                    below[o] = depth[s] + 1
                    holder[o] = min(holder.get(o, (s, p)), (s, p))
        depth |= below
        level = [*below]
    texts: dict[str, str] = {}
    for s in reversed(depth):
        props: dict[str, list] = defaultdict(list)
        for p, o, *more in triples[s]:
            inside = holder.get(o) == (s, p)
            props[p].append(texts[o] if inside else _quoted(o) if p == TYPE else _value(p, o, *more))
        texts[s] = _node(s, props)
        for o in {o for _, o, *_ in triples[s] if holder.get(o, (None,))[0] == s}:
            del texts[o]
    return texts[root]


def trees(graph: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, root, value): each root's JSON-LD document as one tree.

    A node stands inside the first triple, by subject and predicate, of those that lead to it by the
    shortest way; everywhere else, and so on every cycle, it is a reference. A graph is one document and is
    folded by one task, from the deepest level up.
    """
    named = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
    marks = roots.select(*keys, F.col("root").alias("s"), *[F.lit(None).cast("string").alias(c) for c in TERMS[1:]])
    return by_group(graph.where("p is not null").select(*keys, *TERMS).unionByName(marks).where(named), keys, _trees, "root string, value string")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in TERMS])))
def xml_triples(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Triples of RDF/XML texts; null where a text is missing or breaks."""
    kind = pa.list_(pa.struct([(c, pa.string()) for c in TERMS]))
    for column in texts:
        out = []
        for text in column.to_pylist():
            try:
                blank = hashlib.sha1((text or "").encode()).hexdigest()[:12]
                out.append([dict(zip(TERMS, t)) for t in rdfxml.triples(text.encode(), blank)] if text else None)
            except rdfxml.ET.ParseError:
                out.append(None)
        yield pa.array(out, kind)


def socrata_triples(records: DataFrame, keys: list[str]) -> DataFrame:
    """All triples of Socrata records {view, dcat} with `apiuri`, rewritten to the dataset's address.

    The node with the view's identifier becomes the dataset; owner and author become publisher and
    contact; each download becomes a distribution with the media type and the label of its format;
    the portal's own dates become the usual ones. Every other triple stays as it is.
    """
    doc_ = F.try_parse_json("raw")
    view_id = doc.get(doc_, "view.id")
    rows = records.select(
        *keys, F.concat(F.rtrim("apiuri", F.lit("/")), F.lit("/dataset/"), view_id).alias("uri"), view_id.alias("view_id"),
        doc.get(doc_, "view.owner.displayName").alias("owner"), doc.get(doc_, "view.tableAuthor.displayName").alias("author"), xml_triples(doc.get(doc_, "dcat")).alias("t"),
    )
    rows = staged(rows.where("t is not null"), "socrata")
    named = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
    told = lambda x: (x["p"] == DCT + "identifier") & (x["o"] == F.col("view_id"))
    rows = rows.withColumn("about", F.when(named, F.array_min(F.transform(F.filter("t", told), lambda x: x["s"]))))
    on_set = lambda c: F.when(c.eqNullSafe(F.col("about")), F.col("uri")).otherwise(c)
    dates = {ODS + "created": DCT + "issued", ODS + "last_modified": DCT + "modified"}
    dated = lambda p: F.coalesce(*[F.when(p == a, b) for a, b in dates.items()], p)
    of = lambda s, p, o, kind, o_type=None, lang=None: F.struct(
        s.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.alias("o"), (F.lit(kind) if isinstance(kind, str) else kind).alias("o_kind"),
        *[(F.lit(None).cast("string") if v is None else v).alias(c) for c, v in (("o_type", o_type), ("o_lang", lang))],
    )
    own = lambda x: of(on_set(x["s"]), dated(x["p"]), F.when(x["o_kind"] != "literal", on_set(x["o"])).otherwise(x["o"]), x["o_kind"], x["o_type"], x["o_lang"])
    rows = rows.withColumn("t", F.transform("t", own))

    # a record's triples are looked up in its own row: its downloads, then the formats that these refer to
    downloads = F.array_distinct(F.transform(F.filter("t", lambda x: x["p"] == DCAT + "distribution"), lambda x: x["o"]))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("downloads", F.when(named, F.array_compact(downloads)).otherwise(none))
    dist = lambda n: F.when(F.array_contains("downloads", n), node_id(angle(F.col("uri")), n))
    placed = F.transform("t", lambda x: F.struct(x.alias("t"), dist(x["s"]).alias("dist"), dist(x["o"]).alias("o_dist")))
    rows = rows.withColumn("t", placed)
    is_format = lambda x: x["dist"].isNotNull() & (x["t"]["p"] == DCT + "format") & (x["t"]["o_kind"] != "literal")
    is_kind = lambda x: x["dist"].isNotNull() & (x["t"]["p"] == TYPE)
    rows = rows.withColumn("formats", F.transform(F.filter("t", is_format), lambda x: F.struct(x["dist"].alias("dist"), x["t"]["o"].alias("format"))))
    kept = F.transform(
        F.filter("t", lambda x: ~is_format(x) & ~is_kind(x)),
        lambda x: of(
            F.coalesce(x["dist"], x["t"]["s"]), x["t"]["p"], F.coalesce(x["o_dist"], x["t"]["o"]),
            F.when(x["o_dist"].isNotNull(), "bnode").otherwise(x["t"]["o_kind"]), x["t"]["o_type"], x["t"]["o_lang"],
        ),
    )

    def says(predicate: str, build: Callable[[Column, Column], Column]) -> Column:
        about = lambda f: F.filter("t", lambda x: (x["t"]["s"] == f["format"]) & (x["t"]["p"] == predicate))
        return F.flatten(F.transform("formats", lambda f: F.transform(about(f), lambda x: build(f["dist"], x["t"]["o"]))))

    def agent(who: str, predicate: str, prop: str, kind: str) -> Column:
        node = node_id(angle(F.col("uri")), angle(F.lit(prop if who == "author" else predicate)), F.col(who))
        some = F.array(of(F.col("uri"), predicate, node, "bnode"), of(node, TYPE, F.lit(kind), "uri"), of(node, prop, F.col(who), "literal"))
        return F.when(F.col(who).isNotNull() & F.col("view_id").isNotNull(), some)

    parts = [
        kept,
        says(RDF + "value", lambda dist, text: of(dist, DCAT + "mediaType", text, "literal")),
        says(RDFS + "label", lambda _, text: of(text, TYPE, F.lit(DCT + "MediaTypeOrExtent"), "uri")),
        F.transform("downloads", lambda n: of(dist(n), TYPE, F.lit(DCAT + "Distribution"), "uri")),
        F.when(F.col("view_id").isNotNull(), F.array(of(F.col("uri"), TYPE, F.lit(DCAT + "Dataset"), "uri"))),
        agent("owner", DCT + "publisher", FOAF + "name", FOAF + "Organization"),
        agent("author", DCAT + "contactPoint", VCARD + "fn", VCARD + "Organization"),
    ]
    kind = "array<struct<" + ",".join(f"{c}:string" for c in TERMS) + ">>"
    every = F.flatten(F.array_compact(F.array(*[part.cast(kind) for part in parts])))
    return rows.select(*keys, F.inline(F.array_distinct(every))).distinct()


ship(rdfxml.__name__)
ship(__name__)
