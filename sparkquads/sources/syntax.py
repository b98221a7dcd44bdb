"""Parsers of whole RDF documents: Turtle, TriG, RDF/XML and JSON-LD. They yield quads of canonical terms.

Notation3 is read as far as it is Turtle. JSON-LD contexts must be in the document; remote ones are an error.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from ..functions import terms
from ..schema import RDF, XSD

Quad = tuple[str, str, str, str]

_TOKEN = re.compile(
    r"""\s+|\#[^\n\r]*
    |(?P<iri><[^\x00-\x20<>"{}|^`]*>)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:[\w](?:[\w.\-·]*[\w\-·])?)
    |(?P<double>[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)
    |(?P<decimal>[+-]?\d*\.\d+)
    |(?P<integer>[+-]?\d+)
    |(?P<name>(?:[^\W\d_](?:[\w.\-·]*[\w\-·])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>\^\^|[.;,\[\](){}=])""",
    re.X | re.S,
)


class _Turtle:
    def __init__(self, text: str, base: str, trig: bool):
        self.base, self.trig, self.prefixes, self.out, self.graph, self.made = base, trig, {}, [], "", 0
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.labels = {v for k, v in self.tokens if k == "blank"}
        self.i = 0

    def peek(self, offset: int = 0) -> tuple[str, str]:
        return self.tokens[self.i + offset] if self.i + offset < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.i += 1
        return t

    def expect(self, mark: str) -> None:
        if (t := self.next())[1] != mark or t[0] != "mark":
            raise ValueError(f"expected {mark!r}, found {t[1]!r}")

    def fresh(self) -> str:
        """A label that the document doesn't use."""
        while True:
            self.made += 1
            if (label := f"_:genid{self.made}") not in self.labels:
                return label

    def resolve(self, iri: str) -> str:
        full = terms.unescape(iri) if "\\" in iri else iri
        if not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", full):
            if not self.base:
                raise ValueError(f"relative IRI without a base: {iri!r}")
            full = urljoin(self.base, full)
        return f"<{full}>"

    def document(self) -> list[Quad]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            low = value.lower()
            if (kind == "at" and low in ("@prefix", "@base")) or (kind == "word" and low in ("prefix", "base")):
                self.directive(low)
            elif self.trig and (kind == "word" and low == "graph" or value == "{" or self.peek(1) == ("mark", "{") or (value == "[" and self.peek(2) == ("mark", "{"))):
                if kind == "word":
                    self.next()
                name = "" if self.peek()[1] == "{" else self.term()
                self.expect("{")
                self.graph = name
                while self.peek() != ("mark", "}"):
                    self.triples()
                    if self.peek() == ("mark", "."):
                        self.next()
                    elif self.peek() != ("mark", "}"):
                        raise ValueError(f"expected '.' or '}}', found {self.peek()[1]!r}")
                self.next()
                self.graph = ""
            else:
                self.triples()
                self.expect(".")
        return self.out

    def directive(self, low: str) -> None:
        self.next()
        if low.endswith("prefix"):
            kind, name = self.next()
            if kind != "name" or not name.endswith(":"):
                raise ValueError(f"not a prefix: {name!r}")
            self.prefixes[name[:-1]] = self.resolve(self.next()[1][1:-1])[1:-1]
        else:
            self.base = self.resolve(self.next()[1][1:-1])[1:-1]
        if low.startswith("@"):
            self.expect(".")

    def triples(self) -> None:
        if self.peek() == ("mark", "["):
            s = self.term()
            if self.peek()[1] in (".", "}"):
                return
        else:
            s = self.term()
        if s.startswith('"'):
            raise ValueError(f"a literal can't be a subject: {s}")
        self.properties(s)

    def properties(self, s: str) -> None:
        while True:
            p = self.verb()
            while True:
                self.out.append((s, p, self.term(), self.graph))
                if self.peek() != ("mark", ","):
                    break
                self.next()
            if self.peek() != ("mark", ";"):
                return
            while self.peek() == ("mark", ";"):
                self.next()
            if self.peek()[0] == "end" or (self.peek()[0] == "mark" and self.peek()[1] in ".]}"):
                return

    def verb(self) -> str:
        if self.peek() == ("word", "a"):
            self.next()
            return f"<{RDF}type>"
        p = self.term()
        if not p.startswith("<"):
            raise ValueError(f"a predicate is an IRI: {p}")
        return p

    def term(self) -> str:
        kind, value = self.next()
        if kind == "iri":
            return self.resolve(value[1:-1])
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return terms.iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "blank":
            return value
        if kind in ("text", "long"):
            n = 3 if kind == "long" else 1
            lexical = terms.unescape(value[n:-n])
            if self.peek()[0] == "at":
                return terms.literal(lexical, self.next()[1][1:])
            if self.peek() == ("mark", "^^"):
                self.next()
                return terms.literal(lexical, None, self.term()[1:-1])
            return terms.literal(lexical)
        if kind in ("integer", "decimal", "double"):
            return terms.literal(value, None, XSD + kind)
        if kind == "word" and value in ("true", "false"):
            return terms.literal(value, None, XSD + "boolean")
        if value == "[":
            node = self.fresh()
            if self.peek() != ("mark", "]"):
                self.properties(node)
            self.expect("]")
            return node
        if value == "(":
            items = []
            while self.peek() != ("mark", ")"):
                items.append(self.term())
            self.next()
            return _list(items, self.fresh, lambda s, p, o: self.out.append((s, p, o, self.graph)))
        raise ValueError(f"unexpected {value!r}")


def _list(items: list[str], fresh, add) -> str:
    head = f"<{RDF}nil>"
    for x in reversed(items):
        node = fresh()
        add(node, f"<{RDF}first>", x)
        add(node, f"<{RDF}rest>", head)
        head = node
    return head


def _rdfxml(text: str, base: str) -> Iterator[Quad]:
    """RDF/XML with typed nodes, property attributes, parseType, rdf:li, xml:base and xml:lang."""
    made = iter(range(1, 1 << 62))
    fresh = lambda: f"_:genid{next(made)}"
    xml = "{http://www.w3.org/XML/1998/namespace}"
    r = "{" + RDF + "}"
    out: list[Quad] = []
    add = lambda s, p, o: out.append((s, p, o, ""))
    name = lambda tag: terms.iri(tag[1:].replace("}", "", 1) if tag.startswith("{") else tag)

    def resolve(x: str, b: str) -> str:
        return terms.iri(x if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", x) else urljoin(b, x))

    def node(e: ET.Element, b: str, lang: str | None) -> str:
        b, lang = e.get(xml + "base", b), e.get(xml + "lang", lang)
        if r + "about" in e.attrib:
            s = resolve(e.get(r + "about"), b)
        elif r + "ID" in e.attrib:
            s = resolve("#" + e.get(r + "ID"), b)
        else:
            s = "_:" + e.get(r + "nodeID") if r + "nodeID" in e.attrib else fresh()
        if e.tag != r + "Description":
            add(s, f"<{RDF}type>", name(e.tag))
        attributes(s, e, b, lang, ("about", "ID", "nodeID"))
        properties(s, e, b, lang)
        return s

    def attributes(s: str, e: ET.Element, b: str, lang: str | None, but: tuple[str, ...]) -> None:
        for k, v in e.attrib.items():
            if not k.startswith(xml) and k not in [r + x for x in but]:
                add(s, name(k), resolve(v, b) if k == r + "type" else terms.literal(v, lang))

    def properties(s: str, e: ET.Element, b: str, lang: str | None) -> None:
        n = 0
        for c in e:
            cb, cl = c.get(xml + "base", b), c.get(xml + "lang", lang)
            p = name(c.tag)
            if c.tag == r + "li":
                n += 1
                p = f"<{RDF}_{n}>"
            how = c.get(r + "parseType")
            if how == "Resource":
                o = fresh()
                properties(o, c, cb, cl)
            elif how == "Collection":
                o = _list([node(x, cb, cl) for x in c], fresh, add)
            elif how is not None:
                o = terms.literal((c.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in c), None, RDF + "XMLLiteral")
            elif len(c):
                o = node(c[0], cb, cl)
            elif r + "resource" in c.attrib:
                o = resolve(c.get(r + "resource"), cb)
                attributes(o, c, cb, cl, ("resource", "ID"))
            elif r + "nodeID" in c.attrib:
                o = "_:" + c.get(r + "nodeID")
                attributes(o, c, cb, cl, ("nodeID", "ID"))
            elif any(not k.startswith((xml, r)) for k in c.attrib):
                o = fresh()
                attributes(o, c, cb, cl, ("ID",))
            else:
                datatype = c.get(r + "datatype")
                o = terms.literal(c.text or "", None if datatype else cl, resolve(datatype, cb)[1:-1] if datatype else None)
            add(s, p, o)
            if r + "ID" in c.attrib:
                x = resolve("#" + c.get(r + "ID"), cb)
                for k, v in (("type", f"<{RDF}Statement>"), ("subject", s), ("predicate", p), ("object", o)):
                    add(x, f"<{RDF}{k}>", v)

    root = ET.fromstring(text)
    base = root.get(xml + "base", base)
    for e in root if root.tag == r + "RDF" else [root]:
        node(e, base, root.get(xml + "lang"))
    yield from out


def _jsonld(text: str, base: str) -> Iterator[Quad]:
    made = iter(range(1, 1 << 62))
    fresh = lambda: f"_:genid{next(made)}"
    out: list[Quad] = []

    def merged(ctx: dict, new) -> dict:
        for c in new if isinstance(new, list) else [new]:
            if c is None:
                ctx = {"@base": base}
            elif isinstance(c, str):
                raise ValueError(f"remote contexts aren't read: {c}")
            else:
                ctx = ctx | c
        return ctx

    def expand(x: str, ctx: dict, vocab: bool) -> str:
        if x.startswith(("@", "_:")):
            return x
        if vocab and x in ctx:
            d = ctx[x]
            d = d.get("@id", x) if isinstance(d, dict) else d
            if d is None or d == x:
                return ctx.get("@vocab", "") + x
            return expand(d, {k: v for k, v in ctx.items() if k != x}, True)
        prefix, colon, rest = x.partition(":")
        if colon and not rest.startswith("//") and prefix in ctx:
            return expand(prefix, ctx, True) + rest
        if colon:
            return x
        return ctx["@vocab"] + x if vocab and ctx.get("@vocab") else urljoin(ctx.get("@base") or base, x)

    def name(x: str) -> str:
        return x if x.startswith("_:") else terms.iri(x)

    def value(v, ctx: dict, kind: str | None, lang: str | None, graph: str) -> str | None:
        if isinstance(v, dict):
            if "@value" in v:
                t, x = v.get("@type"), v["@value"]
                if isinstance(x, str):
                    return terms.literal(x, v.get("@language"), t and expand(t, ctx, True))
                return value(x, ctx, t and expand(t, ctx, True), None, graph)
            if "@list" in v:
                items = v["@list"] if isinstance(v["@list"], list) else [v["@list"]]
                got = [y for x in items if (y := value(x, ctx, kind, lang, graph)) is not None]
                return _list(got, fresh, lambda s, p, o: out.append((s, p, o, graph)))
            return node(v, ctx, graph)
        if kind in ("@id", "@vocab") and isinstance(v, str):
            return name(expand(v, ctx, kind == "@vocab"))
        if isinstance(v, bool):
            return terms.literal("true" if v else "false", None, kind or XSD + "boolean")
        if isinstance(v, int) or (isinstance(v, float) and v.is_integer() and abs(v) < 1e21 and kind != XSD + "double"):
            return terms.literal(str(int(v)), None, kind or XSD + "integer")
        if isinstance(v, float):
            mantissa, _, exponent = f"{v:.15E}".partition("E")
            mantissa = mantissa.rstrip("0")
            return terms.literal(f"{mantissa}{'0' if mantissa.endswith('.') else ''}E{int(exponent)}", None, kind or XSD + "double")
        return None if v is None else terms.literal(v, None if kind else lang, kind)

    def node(e: dict, ctx: dict, graph: str) -> str:
        if "@context" in e:
            ctx = merged(ctx, e["@context"])
        keys = {k: expand(k, ctx, True) for k in e if k != "@context"}
        own = next((e[k] for k, x in keys.items() if x == "@id"), None)
        s = name(expand(own, ctx, False)) if own is not None else fresh()
        for k, x in keys.items():
            v = e[k]
            many = v if isinstance(v, list) else [v]
            if x == "@type":
                out.extend((s, f"<{RDF}type>", name(expand(t, ctx, True)), graph) for t in many)
            elif x == "@graph":
                inner = s if own is not None or len(keys) > 1 else ""
                for n in many:
                    node(n, ctx, inner)
            elif x == "@reverse":
                for p, vs in v.items():
                    for n in vs if isinstance(vs, list) else [vs]:
                        out.append((name(expand(n, ctx, False)) if isinstance(n, str) else node(n, ctx, graph), name(expand(p, ctx, True)), s, graph))
            elif x == "@included":
                for n in many:
                    node(n, ctx, graph)
            elif not x.startswith("@") and ":" in x:
                d = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
                kind = d.get("@type")
                kind = kind and (kind if kind.startswith("@") else expand(kind, ctx, True))
                lang = d["@language"] if "@language" in d else ctx.get("@language")
                holder = d.get("@container")
                if holder == "@language" and isinstance(v, dict):
                    many = [{"@value": t, "@language": lg} for lg, ts in v.items() for t in (ts if isinstance(ts, list) else [ts])]
                elif holder == "@list" and not (isinstance(v, dict) and "@list" in v):
                    many = [{"@list": many}]
                elif isinstance(v, dict) and "@set" in v:
                    many = v["@set"] if isinstance(v["@set"], list) else [v["@set"]]
                for y in many:
                    o = value(y, ctx, kind, lang, graph)
                    if o is not None:
                        out.append((s, name(x), o, graph))
        return s

    doc = json.loads(text)
    for e in doc if isinstance(doc, list) else [doc]:
        node(e, {"@base": base}, "")
    yield from dict.fromkeys(out)


def parse(text: str, fmt: str, base: str = "") -> Iterator[Quad]:
    """Quads of a document. Blank node labels are kept as they are, those of unnamed nodes are made up."""
    if fmt in ("ttl", "n3", "trig", "nt", "nq"):
        if fmt == "nq":
            for line in text.splitlines():
                if line.strip() and not line.lstrip().startswith("#"):
                    t = _Turtle(line, base, False)
                    found = [t.term() for _ in range(3)]
                    g = "" if t.peek() == ("mark", ".") else t.term()
                    t.expect(".")
                    yield (*found, g)
        else:
            yield from _Turtle(text, base, fmt == "trig").document()
    elif fmt == "rdf":
        yield from _rdfxml(text, base)
    else:
        yield from _jsonld(text, base)
