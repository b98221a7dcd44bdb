"""Terms in their N-Triples form: checks and parts in Python for single terms, as Columns for tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BNODE, IRI, LANG, PLAIN, TYPED, XSD

_LITERAL = re.compile(r'^"(.*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>"{}|^`\s]*)>)?$', re.S)
_IRI = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>\"{}|^`\\]*$")
_BNODE = re.compile(r"^_:[^\s<>\"]+$")
#: The same literal grammar for both engines; the last quote ends the lexical form.
LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "uU":
            code = int(x[1:], 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                raise ValueError(f"no character: {m[0]}")
            return chr(code)
        if x not in _ESCAPES:
            raise ValueError(f"unknown escape {m[0]}")
        return _ESCAPES[x]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.?)", one, text, flags=re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")


def _plain_iri(value: str) -> str:
    """Without \\u and \\U escapes, the only ones that an IRI may have."""
    if "\\" in value:
        if re.search(r"\\(?!u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})", value):
            raise ValueError(f"unknown escape in the IRI {value!r}")
        value = unescape(value)
        if re.search(r'[\x00-\x20<>"{}|^`\\]', value):
            raise ValueError(f"no IRI: {value!r}")
    return value


def iri(value: str) -> str:
    """<value>, which may come with its brackets and with escapes."""
    value = _plain_iri(value[1:-1] if value.startswith("<") and value.endswith(">") else value)
    if not _IRI.match(value):
        raise ValueError(f"not an absolute IRI: {value!r}")
    return f"<{value}>"


def blank(value: str) -> str:
    if not _BNODE.match(value):
        raise ValueError(f"not a blank node: {value!r}")
    return value


def literal(lexical: str, lang: str | None = None, datatype: str | None = None) -> str:
    """Of a value that isn't escaped. xsd:string is left out, as it is what a literal has anyway."""
    out = f'"{escape(lexical)}"'
    if lang:
        return f"{out}@{lang}"
    return out if not datatype or datatype == XSD + "string" else f"{out}^^<{datatype}>"


def literal_parts(term: str) -> tuple[str, str | None, str | None]:
    """(value without escapes, language, datatype)."""
    m = _LITERAL.match(term)
    if not m:
        raise ValueError(f"not a literal: {term!r}")
    return unescape(m[1]), m[2], m[3] and _plain_iri(m[3])


def term(value: str) -> str:
    """Any term in canonical form; an IRI may come bare."""
    if value.startswith('"'):
        return literal(*literal_parts(value))
    return blank(value) if value.startswith("_:") else iri(value)


def coerced(value):
    """A term of another library as N-Triples text; what is text or None already stays. Known are terms of the RDF/JS
    model, as objects or dictionaries with termType and value, and objects that write themselves by n3()."""
    field = lambda x, name: x.get(name) if isinstance(x, dict) else getattr(x, name, None)
    if value is None or isinstance(value, str) and not hasattr(value, "n3"):
        return value
    kind = field(value, "termType")
    if kind is None:
        return str(value.n3()) if callable(getattr(value, "n3", None)) else value
    text = field(value, "value") or ""
    if kind == "NamedNode":
        return iri(text)
    if kind == "BlankNode":
        return blank(f"_:{text.removeprefix('_:')}")
    if kind == "Literal":
        datatype = field(value, "datatype")
        return literal(text, field(value, "language") or None, datatype if isinstance(datatype, str) else field(datatype, "value") if datatype else None)
    if kind == "DefaultGraph":
        return ""
    if kind == "Variable":
        return None
    raise ValueError(f"no RDF term: {kind}")


def as_rdfjs(term: str) -> dict:
    """A term as a dictionary of the RDF/JS model."""
    if term == "":
        return {"termType": "DefaultGraph", "value": ""}
    if term.startswith("_:"):
        return {"termType": "BlankNode", "value": term[2:]}
    if term.startswith("<"):
        return {"termType": "NamedNode", "value": term[1:-1]}
    text, lang, datatype = literal_parts(term)
    kind = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString" if lang else datatype or XSD + "string"
    return {"termType": "Literal", "value": text, "language": lang or "", "datatype": {"termType": "NamedNode", "value": kind}}


def strict_term(value: str) -> str:
    """A term that must show by its first character what it is."""
    if value[:1] not in ("<", '"', "_"):
        raise ValueError(f"neither an IRI in brackets, a blank node nor a literal: {value!r}")
    return term(value)


def subject(value: str) -> str:
    if value.startswith('"'):
        raise ValueError(f"a subject is an IRI or a blank node: {value!r}")
    return term(value)


def predicate(value: str) -> str:
    if value.startswith(('"', "_:")):
        raise ValueError(f"a predicate is an IRI: {value!r}")
    return iri(value)


def graph(value: str) -> str:
    """The default graph is "", also given as default or []."""
    return "" if value in ("", "default", "[]") else subject(value)


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped(c: Column) -> Column:
    return _replaced(c, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")])


def unescaped(c: Column) -> Column:
    """Without N-Triples escapes, by replacement where there are only those that escaped() makes, else by the JSON reader
    of the JVM, whose escapes are the same but for \\U, \\' and \\/. Any other escape is an error."""
    far = F.regexp_extract_all(c, F.lit(r"(?<!\\)(?:\\\\)*\\U(00(?:0[1-9A-Fa-f]|10)[0-9A-Fa-f]{4})"), 1)
    wide = F.aggregate(far, c, lambda text, m: F.replace(text, F.concat(F.lit("\\U"), m), F.decode(F.unhex(m), "UTF-32")))
    near = F.regexp_replace(F.regexp_replace(wide, r"(?<!\\)((?:\\\\)*)\\U0000", r"$1\\u"), r"(?<!\\)((?:\\\\)*)\\'", "$1'")
    json = F.concat(F.lit('["'), _replaced(near, [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]), F.lit('"]'))
    read = F.get(F.from_json(json, "array<string>", {"allowUnquotedControlChars": "true"}), 0)
    unknown = F.raise_error(F.concat(F.lit("unknown escape in "), c)).cast("string")
    slash = c.rlike(r"(?<!\\)(?:\\\\)*\\/")
    rest = _replaced(c, [("\\\\", ""), ('\\"', ""), ("\\n", ""), ("\\r", "")])
    usual = ~(rest.contains("\\") | rest.contains('"') | c.contains("\x01"))
    quick = _replaced(c, [("\\\\", "\x01"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\x01", "\\")])
    return F.when(c.contains("\\"), F.when(usual, quick).when(slash, unknown).otherwise(F.coalesce(read, unknown))).otherwise(c)


def decoded_iri(c: Column) -> Column:
    """An IRI in brackets without \\u and \\U escapes. Other escapes, and characters that no IRI may have, are an error."""
    plain = unescaped(c)
    bad = c.rlike(r"\\[^uU]") | plain.rlike(r'^<.*[\x00-\x20<>"{}|^`\\].*>$')
    return F.when(c.contains("\\"), F.when(bad, F.raise_error(F.concat(F.lit("no IRI: "), c)).cast("string")).otherwise(plain)).otherwise(c)


def canonical(o: Column) -> Column:
    """A term whose IRI has no escapes, or whose literal has canonical ones and no xsd:string."""
    lex, lang = F.regexp_extract(o, LITERAL, 1), F.regexp_extract(o, LITERAL, 2)
    datatype = decoded_iri(F.concat(F.lit("<"), F.regexp_extract(o, LITERAL, 3), F.lit(">")))
    tail = F.when(lang != "", F.concat(F.lit("@"), lang)).when(~datatype.isin("<>", f"<{XSD}string>"), F.concat(F.lit("^^"), datatype)).otherwise("")
    again = F.concat(F.lit('"'), escaped(unescaped(lex)), F.lit('"'), tail)
    text = F.when(o.contains("\\") | o.endswith(f"<{XSD}string>") | o.contains("\n") | o.contains("\r"), again).otherwise(o)
    return F.when(o.startswith('"'), text).otherwise(decoded_iri(o))


def cut(o: Column) -> Column:
    """A term's kind, value with its escapes, datatype and language, as a structure of k, v, d, l. A literal that ends as
    most do is cut at its last quote, any other is matched by LITERAL."""
    end = F.substring_index(o, '"', -1)
    whole = F.length(o) > F.length(end) + 1
    lang = end.rlike(r"^@[A-Za-z0-9-]+\z")
    datatype = end.startswith("^^<") & (F.instr(end, ">") == F.length(end))
    part = lambda i: F.regexp_extract(o, LITERAL, i)
    kind = lambda lang, datatype: F.when(lang != "", LANG).when((datatype != "") & (datatype != XSD + "string"), TYPED).otherwise(PLAIN)
    made = lambda k, lang, datatype: F.struct(k.cast("int").alias("k"), o.substr(F.lit(2), F.length(o) - F.length(end) - 2).alias("v"), datatype.alias("d"), lang.alias("l"))
    none, iri_ = F.lit(None).cast("string"), F.substr(end, F.lit(4), F.length(end) - 4)
    fixed = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"), none.alias("d"), none.alias("l"))
    matched = F.struct(kind(part(2), part(3)).cast("int").alias("k"), part(1).alias("v"), part(3).alias("d"), part(2).alias("l"))
    return (
        F.when(o.startswith("<"), fixed(IRI, o.substr(F.lit(2), F.length(o) - 2)))
        .when(o.startswith("_:"), fixed(BNODE, o.substr(F.lit(3), F.length(o))))
        .when(~o.startswith('"') | ~whole, matched)
        .when(end == "", made(F.lit(PLAIN), none, none))
        .when(lang, made(F.lit(LANG), F.substr(end, F.lit(2)), none))
        .when(datatype, made(kind(F.lit(""), iri_), none, iri_))
        .otherwise(matched)
    )


def typed_columns(o: Column, parts: Column | None = None) -> dict[str, Column]:
    """o_kind, o_value (without brackets, quotes and escapes), o_datatype, o_lang; the last two null but for their kind.
    parts may be a column that has cut(o) already, so that it is made once."""
    parts = cut(o) if parts is None else parts
    k, value = parts["k"], parts["v"]
    return {
        "o_kind": k,
        "o_value": F.when(k.isin(IRI, BNODE), value).otherwise(unescaped(value)),
        "o_datatype": F.when(k == TYPED, parts["d"]),
        "o_lang": F.when(k == LANG, parts["l"]),
    }


def composed(kind: Column, value: Column, datatype: Column, lang: Column) -> Column:
    text = F.concat(F.lit('"'), escaped(value), F.lit('"'))
    return (
        F.when(kind == IRI, F.concat(F.lit("<"), value, F.lit(">")))
        .when(kind == BNODE, F.concat(F.lit("_:"), value))
        .when(kind == LANG, F.concat(text, F.lit("@"), lang))
        .when(kind == TYPED, F.concat(text, F.lit("^^<"), datatype, F.lit(">")))
        .otherwise(text)
    )
