import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkquads import DEFAULT_GRAPH, Pattern
from sparkquads.functions import terms
from sparkquads.plans.pattern import access_path, tail_needs_compaction
from sparkquads.schema import XSD, options
from sparkquads.sources.formats import detect_format, format_from_name
from sparkquads.sources.syntax import parse

HARD = ['"a^^<http://b>"', '"a^^b"', '"x\\"@en"', '""', '"say \\"hi\\""@en', '"back\\\\slash"', '"line\\nbreak"', '"é😀"', '"7"^^<' + XSD + 'byte>', '"an @ inside"', "<http://a/b>", "_:b0"]
text = st.text(st.characters(exclude_categories=["Cs"]), max_size=30)


@given(text, st.sampled_from([None, "en", "en-GB"]))
def test_a_literal_has_its_parts(value, lang):
    assert terms.literal_parts(terms.literal(value, lang)) == (value, lang, None)
    assert terms.literal_parts(terms.literal(value, None, "http://d/t")) == (value, None, "http://d/t")


@given(text, st.sampled_from(["", "@en", "^^<http://d/t>"]))
def test_a_document_gives_back_its_quad(value, tail):
    quad = ("<http://s>", "<http://p>", f'"{terms.escape(value)}"{tail}', "")
    assert list(parse(" ".join(quad) + " .", "ttl")) == [quad]


@pytest.mark.parametrize("term", HARD)
def test_canonical_terms_stay(term):
    assert terms.term(term) == term


def test_terms_in_their_positions():
    assert terms.term("http://a/b") == "<http://a/b>"
    assert terms.literal("x", None, XSD + "string") == '"x"'
    assert [terms.graph(g) for g in ("", "default", "[]")] == [""] * 3
    for bad in ("plain text", "<no scheme>", "_:", '"open'):
        with pytest.raises(ValueError):
            terms.term(bad)
    with pytest.raises(ValueError):
        terms.strict_term("http://a/b")
    for bad in ({"s": '"x"'}, {"p": "_:b"}, {"s": 3}, {"g": '"x"'}):
        with pytest.raises(ValueError):
            Pattern.of(**bad)
    assert Pattern.of(g=DEFAULT_GRAPH).bound == {"g": ""}


def test_columns_agree_with_python(spark):
    from pyspark.sql import functions as F

    wide = [*HARD, '"\\u00e9\\U0001F600\\t\\\'"', '"\\\\u00e9"', f'"s"^^<{XSD}string>']
    df = spark.createDataFrame([(t,) for t in wide], "o string").select("o", terms.canonical(F.col("o")).alias("c"), *(c.alias(k) for k, c in terms.typed_columns(F.col("o")).items()))
    for r in df.collect():
        assert r.c == terms.term(r.o)
        if r.o.startswith('"'):
            value, lang, datatype = terms.literal_parts(r.o)
            assert (r.o_value, r.o_lang, r.o_datatype) == (value, lang, None if datatype == XSD + "string" else datatype)
        else:
            assert r.o_kind == int(r.o.startswith("_:"))


def test_access_paths():
    po = Pattern(p="<p>", o='"o"')
    assert access_path(po, ("by_reference", "by_copy")) == "posg"
    assert access_path(po, ("by_reference",)) == "ref_o"
    assert access_path(Pattern(p="<p>"), ("by_reference",)) == "ref_p"
    assert access_path(Pattern(o='"o"'), ("by_copy",)) == "ospg"
    assert access_path(Pattern(s="<s>", o='"o"'), ("by_copy", "by_reference")) == "base"
    assert access_path(Pattern(g=""), ("by_copy",)) == access_path(po, ()) == "base"


def test_when_a_tail_is_compacted():
    cases = {(0, 0): False, (4_095, 10): False, (4_096, 10): True, (4_096, 100_000): False, (10_000, 100_000): True, (99_999, 10**9): False, (100_000, 10**9): True}
    assert {k: tail_needs_compaction(*k) for k in cases} == cases


def test_options_and_formats():
    assert options("TypedObject", ["by-copy", "ByCopy"], "SortedStream") == ("typed_object", ("by_copy",), "sorted_stream")
    for bad in (("x", (), "sorted_stream"), ("default", ["x"], "sorted_stream"), ("default", (), "x")):
        with pytest.raises(ValueError):
            options(*bad)
    assert format_from_name("N-Quads") == "nq" and detect_format("/a/b.TTL") == "ttl" and detect_format("/a/b") is None
    with pytest.raises(ValueError):
        format_from_name("csv")


def test_turtle_and_trig():
    doc = """@prefix e: <http://e/> . @base <http://b/> .
e:s a e:C ; e:p "x"@en, 'y', 1, 1.5, 1e3, true ; e:l (1 [ e:q <r> ]) .  # a comment
e:t.x e:p \"\"\"long "text"
here\"\"\" ."""
    got = {(s, p, o) for s, p, o, _ in parse(doc, "ttl")}
    assert ("<http://e/s>", "<http://e/p>", f'"1.5"^^<{XSD}decimal>') in got
    assert ("<http://e/t.x>", "<http://e/p>", '"long \\"text\\"\\nhere"') in got
    assert any(o == "<http://b/r>" for _, _, o in got) and len(got) == 14
    quads = list(parse("@prefix e: <http://e/> . e:g { e:a e:b e:c . e:a e:b 'd' } GRAPH e:h { [] e:b e:c } e:a e:b e:c . { e:x e:y e:z }", "trig"))
    assert [q[3] for q in quads] == ["<http://e/g>"] * 2 + ["<http://e/h>", "", ""]
    for bad in ("<http://a> <http://b> .", "<http://a> _:b <http://c> .", "e:a e:b e:c .", "<a> <b> <c> ."):
        with pytest.raises(ValueError):
            list(parse(bad, "ttl"))


def test_xml_and_json():
    xml = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://b/">
<e:C rdf:about="s" e:k="v"><e:p xml:lang="en">x</e:p><e:q rdf:resource="o"/><e:r rdf:parseType="Resource"><e:n rdf:datatype="http://t">1</e:n></e:r></e:C></rdf:RDF>"""
    got = {q[:3] for q in parse(xml, "rdf")}
    assert {("<http://b/s>", "<http://e/p>", '"x"@en'), ("<http://b/s>", "<http://e/q>", "<http://b/o>"), ("<http://b/s>", "<http://e/k>", '"v"')} < got and len(got) == 6
    js = """{"@context": {"e": "http://e/", "name": {"@id": "e:name", "@language": "en"}, "knows": {"@id": "e:knows", "@type": "@id"}},
"@id": "http://s", "@type": "e:C", "name": "x", "knows": "http://o", "e:n": [1, 2.5, true, {"@value": "v", "@type": "http://t"}]}"""
    got = {q[:3] for q in parse(js, "jsonld")}
    assert {("<http://s>", "<http://e/name>", '"x"@en'), ("<http://s>", "<http://e/knows>", "<http://o>"), ("<http://s>", "<http://e/n>", f'"2.5E0"^^<{XSD}double>')} < got and len(got) == 7
