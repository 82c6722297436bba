"""RDF/XML text to triples, one file at a time."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import count
from urllib.parse import urljoin

RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
XML = "{http://www.w3.org/XML/1998/namespace}"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
#: Attributes of the syntax itself; all others are properties.
SYNTAX = {RDF + n for n in ("about", "ID", "nodeID", "resource", "datatype", "parseType")} | {XML + "lang", XML + "base"}

#: subject, predicate, object, kind of object (uri, bnode, literal), datatype, language
Triple = tuple[str, str, str, str, str | None, str | None]


def _iri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class _Reader:
    def __init__(self, blank: str):
        self.blank, self.number = blank, count()

    def fresh(self) -> str:
        return f"_:{self.blank}x{next(self.number)}"

    def subject(self, el: ET.Element, base: str) -> str:
        if (about := el.get(RDF + "about")) is not None:
            return urljoin(base, about.strip()) if base else about.strip()
        if (ident := el.get(RDF + "ID")) is not None:
            return f"{base}#{ident}"
        if (node := el.get(RDF + "nodeID")) is not None:
            return f"_:{self.blank}n{node}"
        return self.fresh()

    def node(self, el: ET.Element, base: str, lang: str | None, name: str | None = None) -> Iterator[Triple]:
        """A node element; `name` is its subject where that is known already."""
        base, lang = el.get(XML + "base", base), el.get(XML + "lang", lang)
        s = name or self.subject(el, base)
        if el.tag != RDF + "Description":
            yield s, TYPE, _iri(el.tag), "uri", None, None
        yield from self.attributes(s, el, lang)
        yield from self.properties(s, el, base, lang)

    def attributes(self, s: str, el: ET.Element, lang: str | None) -> Iterator[Triple]:
        for key, v in el.attrib.items():
            if key in SYNTAX or not key.startswith("{"):
                continue
            if key == RDF + "type":
                yield s, TYPE, v.strip(), "uri", None, None
            else:
                yield s, _iri(key), v, "literal", None, lang

    def properties(self, s: str, el: ET.Element, base: str, lang: str | None) -> Iterator[Triple]:
        member = count(1)
        for p in el:
            if not isinstance(p.tag, str):  # comments
                continue
            iri = _iri(p.tag) if p.tag != RDF + "li" else f"{RDF[1:-1]}_{next(member)}"
            yield from self.property(s, iri, p, p.get(XML + "base", base), p.get(XML + "lang", lang))

    def property(self, s: str, iri: str, p: ET.Element, base: str, lang: str | None) -> Iterator[Triple]:
        link = lambda o: (s, iri, o, "bnode" if o.startswith("_:") else "uri", None, None)
        kind, children = p.get(RDF + "parseType"), [x for x in p if isinstance(x.tag, str)]
        if kind == "Resource":
            o = self.fresh()
            yield link(o)
            yield from self.properties(o, p, base, lang)
        elif kind == "Collection":
            yield from self.collection(link, children, base, lang)
        elif kind is not None:
            text = (p.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in p)
            yield s, iri, text, "literal", RDF[1:-1] + "XMLLiteral", None
        elif children:
            for child in children:
                o = self.subject(child, child.get(XML + "base", base))
                yield link(o)
                yield from self.node(child, base, lang, o)
        elif RDF + "resource" in p.attrib or RDF + "nodeID" in p.attrib or any(k not in SYNTAX and k.startswith("{") for k in p.attrib):
            ref = p.get(RDF + "resource")
            o = self.subject(p, base) if ref is None else urljoin(base, ref.strip()) if base else ref.strip()
            yield link(o)
            yield from self.attributes(o, p, lang)
        else:
            yield s, iri, p.text or "", "literal", p.get(RDF + "datatype"), None if RDF + "datatype" in p.attrib else lang

    def collection(self, link, children: list[ET.Element], base: str, lang: str | None) -> Iterator[Triple]:
        nil = RDF[1:-1] + "nil"
        cell = self.fresh() if children else nil
        yield link(cell)
        for i, child in enumerate(children):
            o = self.subject(child, child.get(XML + "base", base))
            rest = self.fresh() if i + 1 < len(children) else nil
            yield cell, RDF[1:-1] + "first", o, "bnode" if o.startswith("_:") else "uri", None, None
            yield cell, RDF[1:-1] + "rest", rest, "bnode" if rest.startswith("_:") else "uri", None, None
            yield from self.node(child, base, lang, o)
            cell = rest


def triples(content: bytes, blank: str, base: str = "") -> Iterator[Triple]:
    """The triples of a file, its blank nodes named after `blank`.

    Elements below the root are read and released one by one. A file that is no well-formed XML raises
    ParseError where it breaks. Relative addresses are kept as they are where no base is known.
    """
    reader, depth, root = _Reader(blank), 0, None
    for event, el in ET.iterparse(io.BytesIO(content), events=("start", "end")):
        if event == "start":
            root = el if root is None else root
            depth += 1
            continue
        depth -= 1
        if depth == 1 and root.tag == RDF + "RDF":
            yield from reader.node(el, root.get(XML + "base", base), root.get(XML + "lang"))
            root.remove(el)
    if root is not None and root.tag != RDF + "RDF":
        yield from reader.node(root, base, None)
