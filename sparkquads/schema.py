"""Columns and types of quads in each layout."""

from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType

QUAD = ("s", "p", "o", "g")
LAYOUTS = ("default", "typed_object", "dictionary")
INDEXES = ("by_reference", "by_copy")
BUILDERS = ("unsorted_stream", "sorted_in_memory", "sorted_stream")

QUADS = StructType([StructField(c, StringType(), False) for c in QUAD])
CODES = StructType([StructField(c, LongType(), False) for c in QUAD])
TYPED_OBJECT = "s string, p string, o_kind int, o_value string, o_datatype string, o_lang string, g string"
TERMS = StructType([StructField("code", LongType(), False), StructField("term", StringType(), False)])

#: Codes of o_kind.
IRI, BNODE, PLAIN, LANG, TYPED = range(5)
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def stored(layout: str, name: str) -> str:
    """The columns of a store's files, so that reading them needs no look into one."""
    term = "bigint" if layout == "dictionary" else "string"
    if name.startswith("dict"):
        return "code bigint, term string"
    if name.startswith("ref_"):
        return f"val {term}, rid bigint"
    if name == "base" and layout == "typed_object":
        return f"{TYPED_OBJECT}, rid bigint"
    return ", ".join(f"{c} {term}" for c in QUAD) + ", rid bigint"


def options(layout: str, indexes, builder: str) -> tuple[str, tuple[str, ...], str]:
    """Checked and normalised build options; names may be in any case and with or without underscores."""

    def known(x: str, names: tuple[str, ...], what: str) -> str:
        plain = {n.replace("_", ""): n for n in names}
        got = plain.get(str(x).lower().replace("_", "").replace("-", ""))
        if got is None:
            raise ValueError(f"unknown {what} {x!r}: one of {', '.join(names)}")
        return got

    chosen = tuple(dict.fromkeys(known(i, INDEXES, "index") for i in ([indexes] if isinstance(indexes, str) else indexes)))
    return known(layout, LAYOUTS, "layout"), chosen, known(builder, BUILDERS, "builder")
