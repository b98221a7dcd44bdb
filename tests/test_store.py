from collections import Counter
from itertools import product

import pyarrow as pa
import pytest

from sparkquads import DEFAULT_GRAPH, QuadStore, StoreError
from sparkquads.__main__ import main
from sparkquads.functions import terms
from sparkquads.schema import BUILDERS, LAYOUTS, QUADS
from sparkquads.sources import convert, rdf_text
from sparkquads.sources.formats import FORMATS

E = "http://example.org/"


def example(n=24):
    return [(f"<{E}s{i:02d}>", f"<{E}p{i % 3}>", f'"object {i % 4}"', "" if i % 2 == 0 else f"<{E}g>") for i in range(n)]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def build(spark, quads, **kw):
    return QuadStore.build(spark.createDataFrame(quads, QUADS), **kw)


MATRIX = [(lay, ix, BUILDERS[i % 3]) for i, (lay, ix) in enumerate(product(LAYOUTS, [(), ("by_copy",), ("by_reference",), ("by_copy", "by_reference")]))]


@pytest.mark.parametrize("layout,indexes,builder", MATRIX)
def test_every_way_to_store_answers_alike(spark, layout, indexes, builder):
    quads = [*example(), *example(3), (f"<{E}s01>", f"<{E}p1>", '"say \\"hi\\""@en', ""), ("_:b", f"<{E}p0>", "_:c", f"<{E}g>")]
    store = build(spark, quads, layout=layout, indexes=indexes, builder=builder)
    assert rows(store.quads()) == Counter(quads) and store.size() == len(quads)
    for bound in ({"p": E + "p0"}, {"o": '"object 1"'}, {"p": E + "p1", "o": '"object 1"'}, {"s": E + "s01"}, {"g": DEFAULT_GRAPH}, {"g": E + "g"}, {"o": '"say \\"hi\\""@en'}, {"o": "_:c"}, {"p": E + "none"}, {"o": '"object 1"@en'}):
        view = store.match(**bound)
        want = Counter(q for q in quads if all(q["spog".index(c)] == ("" if x is DEFAULT_GRAPH else x if x[0] in '"_' else f"<{x}>") for c, x in bound.items()))
        assert rows(view.quads()) == want and view.size() == sum(want.values()), bound
    view = store.match(p=E + "p1").match(o='"object 1"')
    assert {r.s for r in view.quads().collect()} == {f"<{E}s01>", f"<{E}s13>"}
    assert store.match(p=E + "p1").match(p=E + "p2").size() == 0
    assert store.contains(*quads[0]) and not store.contains(quads[0][0], quads[0][1], quads[0][2], E + "other")


@pytest.mark.parametrize("layout", LAYOUTS)
def test_changes(spark, tmp_path, layout):
    quads = [*example(), *example(3)]
    path = f"{tmp_path}/store"
    store = build(spark, quads, path=path, layout=layout, indexes=["by_copy"])
    new = (f"<{E}new>", f"<{E}p0>", '"object 0"', "")
    more = store.add([new, new, quads[0]])
    assert more.tail_len() == 1 and rows(more.quads()) == Counter([*quads, new]) and rows(store.quads()) == Counter(quads)
    assert more.add([new]) is more
    fewer = more.delete(p=E + "p0", g=DEFAULT_GRAPH)
    left = [q for q in quads if not (q[1] == f"<{E}p0>" and q[3] == "")]
    assert rows(fewer.quads()) == Counter(left) and fewer.size() == len(left) and fewer.tail_len() == 0
    again = fewer.add([quads[0]])
    assert rows(again.quads()) == Counter([*left, quads[0]])
    packed = again.compact(indexes=["by_reference"])
    assert rows(packed.quads()) == Counter([*left, quads[0]]) and packed.tail_len() == 0 and packed.indexes == ("by_reference",)
    reopened = QuadStore.open(spark, path)
    assert rows(reopened.quads()) == rows(packed.quads()) and reopened.layout == layout
    assert rows(reopened.delete_quad(*quads[1]).quads()) == Counter([q for q in [*left, quads[0]] if q != quads[1]])


def test_views_and_their_owners(spark, tmp_path):
    store = build(spark, example(), path=f"{tmp_path}/a")
    view = store.match(p=E + "p0")
    for change in (lambda: view.add([]), lambda: view.delete(), lambda: view.compact()):
        with pytest.raises(StoreError, match="owned"):
            change()
    own = view.owned(f"{tmp_path}/b")
    assert own.delete(s=E + "s00").size() == 7 and store.size() == 24 and QuadStore.open(spark, f"{tmp_path}/a").size() == 24
    assert store.match().owned() is not None and store.match().add([example()[0]]).size() == 24
    with pytest.raises(FileNotFoundError):
        QuadStore.open(spark, f"{tmp_path}/none")


def test_a_large_tail_is_compacted(spark):
    quads = lambda a, b: [(f"<{E}s{i:05d}>", f"<{E}p{i % 3}>", f'"object {i % 5}"', "") for i in range(a, b)]
    store = build(spark, quads(0, 10)).add(spark.createDataFrame(quads(10, 110), QUADS))
    assert store.tail_len() == 100
    store = store.add(spark.createDataFrame(quads(110, 4_200), QUADS))
    assert store.tail_len() == 0
    assert store.size() == 4_200 and store.match(o='"object 3"').size() == 840


def test_codes(spark):
    store = build(spark, example(), layout="dictionary")
    words = {r.term: r.code for r in store.terms().collect()}
    assert sorted(words) == sorted(words, key=words.get) and sorted(words.values()) == list(range(len(words)))
    got = store.match(o='"object 1"').codes()
    assert rows(got) == Counter(tuple(words[x] for x in q) for q in example() if q[2] == '"object 1"')
    assert store.decode_code(store.encode_term('"object 1"')) == '"object 1"' and store.encode_term('"none"') is None
    assert store.add([(E + "x", E + "y", E + "z")]).codes() is None and build(spark, example()).codes() is None
    ids, triples = store.match(p=E + "p0").compact_result()
    term = {r.id: r.term for r in ids.collect()}
    assert Counter(tuple(term[x] for x in r) for r in triples.collect()) == Counter(q[:3] for q in example() if q[1] == f"<{E}p0>")


def test_an_empty_store(spark):
    for layout in LAYOUTS:
        store = QuadStore.empty(spark, layout=layout, indexes=["by_copy", "by_reference"])
        assert store.size() == 0 and store.match(p=E + "p").size() == 0
        assert store.add([(E + "s", E + "p", '"x"')]).size() == 1


@pytest.mark.parametrize("fmt", ["nt", "nq", "ttl", "trig", "rdf", "jsonld", "n3"])
def test_formats_round_trip(spark, tmp_path, fmt):
    graphs = fmt in ("nq", "trig", "jsonld")
    quads = [*example(9), (f"<{E}s>", f"<{E}p>", '"a\\nb \\"q\\" \\\\ <&> é"@en', ""), (f"<{E}s>", f"<{E}p>", f'"1"^^<{E}t>', ""), ("_:b", f"<{E}p>", "_:c", "")]
    quads = quads if graphs else [(*q[:3], "") for q in quads]
    path = f"{tmp_path}/out"
    rdf_text.write(spark.createDataFrame(quads, QUADS).coalesce(2), path, fmt)
    assert rows(rdf_text.read(spark, f"{path}/part-*", fmt)) == Counter(quads)


def test_bad_lines(spark, tmp_path):
    (tmp_path / "a.nq").write_text('# comment\n\n<http://s> <http://p> "x\\u00e9" . # more\n')
    assert [tuple(r) for r in rdf_text.read(spark, f"{tmp_path}/a.nq").collect()] == [("<http://s>", "<http://p>", '"xé"', "")]
    (tmp_path / "b.nt").write_text("<http://s> <http://p> x .\n")
    with pytest.raises(Exception, match="no quad"):
        rdf_text.read(spark, f"{tmp_path}/b.nt").collect()
    with pytest.raises(ValueError):
        rdf_text.read(spark, f"{tmp_path}/c")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.ttl").write_text("@prefix e: <http://e/> . e:s e:p 1, 2 .")
    assert main(["serialize", f"{tmp_path}/a.ttl", f"{tmp_path}/store", "--layout", "dictionary", "--index", "by_copy"], spark) == 0
    capsys.readouterr()
    assert main(["match", f"{tmp_path}/store", "--predicate", "http://e/p"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert main(["match", f"{tmp_path}/a.ttl", "--object", '"1"^^<http://www.w3.org/2001/XMLSchema#integer>'], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 1
    assert main(["deserialize", f"{tmp_path}/store", "--output", f"{tmp_path}/out", "--format", "nq"], spark) == 0
    assert rdf_text.read(spark, f"{tmp_path}/out", "nq").count() == 2
    assert main(["match", f"{tmp_path}/store", "--subject", '"x"'], spark) == 2 and main(["serialize", "x", "y"], spark) == 2


def test_all_formats_on_standard_output_are_read_back(spark, tmp_path, capsys):
    """Under each of their names; formats without graphs leave them out."""
    quads = [(f"<{E}s>", f"<{E}p>", '"a <b> & \\"c\\"\\n"@en', f"<{E}g>"), (f"<{E}s>", f"<{E}p>", f'"4"^^<{E}d>', ""), ("_:b", f"<{E}p>", f"<{E}é>", "")]
    path = f"{tmp_path}/store"
    build(spark, quads, path=path)
    for f, others in FORMATS.items():
        for name in (f, others[0], f.upper()):
            assert main(["deserialize", path, "--format", name], spark) == 0
            got = rows(rdf_text.from_string(spark, capsys.readouterr().out, f))
            assert got == Counter(quads if f in ("nq", "trig", "jsonld") else [(*q[:3], "") for q in quads]), name
    assert main(["deserialize", path, "--format", "pdf"], spark) == 2
    assert main(["match", path, "--subject", E + "s", "--graph", "default", "--format", "json-ld"], spark) == 0
    assert rows(rdf_text.from_string(spark, capsys.readouterr().out, "jsonld")) == Counter([quads[1]])


@pytest.mark.parametrize("layout", LAYOUTS)
def test_bytes_tables_and_memory(spark, tmp_path, layout):
    quads = [*example(), *example(3), (f"<{E}s01>", f"<{E}p1>", '"say \\"hi\\""@en', "")]
    path = f"{tmp_path}/store"
    store = build(spark, quads, path=path, layout=layout, indexes=["by_copy"])
    data = store.to_bytes(chunk=5)
    again = QuadStore.from_bytes(spark, data)
    assert rows(again.quads()) == Counter(quads) and (again.layout, again.indexes) == (layout, ("by_copy",))
    assert QuadStore.from_bytes(spark, data, layout="default", indexes=[]).layout == "default"
    view = store.match(p=E + "p1")
    want = Counter(q for q in quads if q[1] == f"<{E}p1>")
    assert rows(QuadStore.from_bytes(spark, view.to_bytes()).quads()) == want == Counter(view)
    assert rows(QuadStore.from_table(*store.ready(), spark=spark).quads()) == Counter(quads)
    held = QuadStore.load(spark, path)
    assert rows(held.match(p=E + "p1").quads()) == want and rows(held.quads()) == Counter(quads) and held._shared.tables
    held.unload()
    assert rows(held.quads()) == Counter(quads) and not held._shared.tables
    assert rows(QuadStore.open(spark, path, resident_terms=0).quads()) == Counter(quads)
    codes = store.code_column("p")
    assert (codes is None) == (layout != "dictionary") and (codes is None or (len(codes) == len(quads) and len(set(codes.tolist())) == 3))
    with pytest.raises(ValueError):
        QuadStore.from_bytes(spark, b"")


@pytest.mark.parametrize("layout", LAYOUTS)
def test_bytes_in_a_folder_pass_the_driver_by(spark, layout, monkeypatch):
    """The quads are never on the driver: an Arrow table or Python rows of them would be an error."""

    def no(*_, **__):
        raise AssertionError("all on the driver")

    quads = [*example(), *example(3), (f"<{E}s01>", f"<{E}p1>", '"say \\"hi\\""@en', "")]
    store = build(spark, quads, layout=layout, indexes=["by_copy"])
    for name in ("ready", "to_bytes", "from_bytes"):
        monkeypatch.setattr(QuadStore, name, no)
    again = QuadStore.read_bytes(spark, store.write_bytes())
    assert rows(again.quads()) == Counter(quads) and (again.layout, again.indexes) == (layout, ("by_copy",))
    changed = store.add([("_:new", E + "p1", '"x"')]).delete(p=E + "p0")
    want = Counter([*[q for q in quads if q[1] != f"<{E}p0>"], ("_:new", f"<{E}p1>", '"x"', "")])
    assert rows(QuadStore.read_bytes(spark, changed.write_bytes(), indexes=[]).quads()) == want
    assert QuadStore.read_bytes(spark, store.match(p=E + "none").write_bytes(), layout="default", indexes=[]).size() == 0


def test_tables_tell_their_layout(spark):
    encoded = pa.table({c: pa.array(x).dictionary_encode() for c, x in zip("spog", zip(*example()))})
    assert rows(QuadStore.from_table(encoded, spark=spark).quads()) == Counter(example())
    with pytest.raises(ValueError, match="dictionary"):
        QuadStore.from_table(pa.table({c: [1] for c in "spog"}), spark=spark)
    with pytest.raises(ValueError, match="columns"):
        QuadStore.from_table(pa.table({"s": ["<a:b>"]}), spark=spark)
    many = QuadStore.ingest(spark, iter(example()), chunk=7)
    assert rows(many.quads()) == Counter(example())
    assert rows(many.add(encoded).quads()) == Counter(example())
    name = {"termType": "NamedNode", "value": E + "p1"}
    assert many.match(p=name).size() == 8
    assert terms.coerced(terms.as_rdfjs('"x"@en')) == '"x"@en' and terms.coerced(terms.as_rdfjs("_:b")) == "_:b"
    assert convert.bytes_to_text(spark, convert.text_to_bytes(spark, "<a:b> <a:c> <a:d> .", "nt"), "nt") == "<a:b> <a:c> <a:d> .\n"


def test_adding_many_subjects_reads_by_range(spark, monkeypatch):
    """Beyond FEW keys, row ids and rows the other ways are taken, with the same results."""
    from sparkquads import store as module

    monkeypatch.setattr(module, "FEW", 3)
    monkeypatch.setattr(module, "ISIN", 1)
    for layout in LAYOUTS:
        store = build(spark, example(), layout=layout, indexes=["by_reference"])
        more = store.add([*example(26), *example(2)])
        assert more.tail_len() == 2 and rows(more.quads()) == Counter(example(26))
        assert more.match(o='"object 1"').size() == 7 and rows(more.match(o='"object 1"').quads()) == Counter(q for q in example(26) if q[2] == '"object 1"')


def test_adding_reads_only_what_has_the_subjects(spark, capsys):
    store = build(spark, example())
    new = spark.createDataFrame([(f"<{E}s03>", f"<{E}p0>", '"object 3"', f"<{E}g>")], QUADS)
    store._present(new).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and f"EqualTo(s,<{E}s03>)" in plan.replace("In(s, [", "EqualTo(s,").replace("])", ")")


def test_escapes_of_iris(spark):
    def one(line):
        return tuple(rdf_text.parsed(spark.createDataFrame([(line,)], "value string")).first())

    assert one(r'<http://e/é> <http://e/\U0001F600> "xé"^^<http://e/dé> <http://e/g> .') == ("<http://e/é>", "<http://e/😀>", '"xé"^^<http://e/dé>', "<http://e/g>")
    for bad in (r"<http://e/\n> <http://e/p> <http://e/o> .", r"<http://e/ > <http://e/p> <http://e/o> .", r'<http://e/s> <http://e/p> "bad \q" .', r'<http://e/s> <http://e/p> "bad \/" .', "no line"):
        with pytest.raises(Exception, match="escape|no IRI|no quad"):
            one(bad)
    assert terms.iri(r"http://e/é") == "<http://e/é>" and terms.term(r'"x"^^<http://e/é>') == '"x"^^<http://e/é>'
    for bad in (r"http://e/\n", r"http://e/>", r"http://e/\u00"):
        with pytest.raises(ValueError):
            terms.iri(bad)


def test_two_writers_of_a_version(spark, tmp_path):
    path = f"{tmp_path}/store"
    store = build(spark, example(), path=path)
    store.add([("<a:s>", "<a:p>", "<a:o>")])
    with pytest.raises(Exception, match="exists"):
        store.add([("<a:s>", "<a:p>", "<a:other>")])
    assert QuadStore.open(spark, path).size() == 25 and not list(tmp_path.glob("store/.manifest*json-*"))


def test_equal_quads_and_hot_terms_are_spread(spark, monkeypatch):
    """Parts are as many as the rows ask for, and no value fills one; the results are those of a broadcast."""
    from sparkquads import storage
    from sparkquads.operators import layouts

    monkeypatch.setattr(storage, "PART", 64)
    monkeypatch.setattr(layouts, "HOT", 50)
    monkeypatch.setattr(layouts, "MOST_BROADCAST_TERMS", 2)
    quads = [(f"<{E}s>", f"<{E}p>", '"x"', "")] * 600 + example()
    store = build(spark, quads, layout="dictionary")
    files = spark.read.parquet(store.manifest["base"]).selectExpr("input_file_name() f").groupBy("f").count().collect()
    assert max(r["count"] for r in files) <= 400 and rows(store.quads()) == Counter(quads)


def test_deleting_keeps_what_is_gone_as_patterns(spark, monkeypatch):
    from sparkquads import store as module

    monkeypatch.setattr(module, "GONE", 1)
    store = build(spark, example(), layout="typed_object").delete(p=E + "p0")
    assert store.manifest["gone"] == [{"p": f"<{E}p0>"}] and not store.manifest["tombs"]
    fewer = store.delete(o='"object 1"')
    assert len(fewer.manifest["tombs"]) == 1
    assert rows(fewer.quads()) == Counter(q for q in example() if q[1] != f"<{E}p0>" and q[2] != '"object 1"') and fewer.size() == len(list(fewer))


def test_encoding_sorts_no_quads_and_carries_no_term_twice(spark, monkeypatch, capsys):
    from sparkquads.operators import layouts

    words = layouts.dictionary(spark.createDataFrame(example(), QUADS)).localCheckpoint()
    layouts.encoded(spark.createDataFrame(example(), QUADS), words, words.count(), most=0, hot={"s": [], "o": []}).explain()
    plan = capsys.readouterr().out
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and " AS _j#" not in plan
    quads = spark.createDataFrame(example(), QUADS)
    pairs = quads.groupBy("p", "g").count()
    assert rows(layouts.dictionary(quads, pairs)) == rows(words)
    assert layouts.hot_values(quads, "so", 24) == {"s": [], "o": []}
    monkeypatch.setattr(layouts, "HOT", 6)
    assert sorted(layouts.hot_values(quads, "so", 24)["o"]) == [f'"object {i}"' for i in range(4)]


def test_a_dictionary_is_compacted_by_codes(spark, monkeypatch):
    """The same dictionary, codes and rows as those of a new store, without decoding; where too much changes, by terms."""
    from sparkquads import store as module
    from sparkquads.operators import layouts

    odd = [("_:z", f"<{E}p9>", '"\uffee"', f"<{E}h>"), ("_:z", f"<{E}p9>", '"\U0001F600"', "")]
    new = [(f"<{E}a>", f"<{E}p1>", '"object 1"', ""), (f"<{E}s05>", f"<{E}p2>", '"zz"@en', f"<{E}new>"), ("_:z", f"<{E}p9>", '"\uffff"', "")]
    store = build(spark, [*example(), *example(3), *odd], layout="dictionary", indexes=["by_copy"]).delete(p=E + "p0").delete(o='"\U0001F600"').add(new)
    want = [*[q for q in [*example(), *example(3)] if q[1] != f"<{E}p0>"], odd[0], *new]
    anew = build(spark, want, layout="dictionary", indexes=["by_copy"])

    def same(packed):
        assert rows(packed.terms()) == rows(anew.terms()) and packed.manifest["terms"] == anew.manifest["terms"]
        for name in ("base", "posg", "ospg", "dict_p", "dict_g"):
            columns = [c for c in packed._read(name).columns if c != "rid"]
            assert rows(packed._read(name).select(columns)) == rows(anew._read(name).select(columns)), name
        assert not packed._fewer and packed.tail_len() == 0 and packed.manifest["base_rows"] == len(want)
        assert [packed.manifest[f"terms_{c}"] for c in "pg"] == [anew.manifest[f"terms_{c}"] for c in "pg"]

    folded = []
    written = module.written
    monkeypatch.setattr(module, "written", lambda df, path: folded.append(path) or written(df, path))
    packed = store.compact()
    same(packed)
    assert not any("folded" in p for p in folded)
    assert rows(packed.quads()) == Counter(want)
    again = packed.compact(indexes=[])  # nothing comes or goes
    assert rows(again.terms()) == rows(anew.terms()) and rows(again.codes()) == rows(anew.codes())
    version = QuadStore(spark, store.path, store.manifest | {"version": again.manifest["version"]})
    monkeypatch.setattr(module, "FEW", 2)
    same(version.compact())
    monkeypatch.setattr(module, "FEW", 4096)
    monkeypatch.setattr(layouts, "MOST_BROADCAST_TERMS", 1)
    same(QuadStore(spark, store.path, store.manifest | {"version": again.manifest["version"] + 1}).compact())
    assert sum("folded" in p for p in folded) == 2


@pytest.mark.parametrize("name,columns", [("index_posg", "posg"), ("index_ospg", "ospg"), ("index_ref_p", "p"), ("index_ref_o", "o")])
def test_row_ids_are_numbered_where_they_lie(spark, monkeypatch, capsys, name, columns):
    """By many files, without moving a row."""
    from sparkquads import queries, storage
    from sparkquads.sources import mapping

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(storage, "PART", 2_000)
    monkeypatch.setattr(queries, "_STORES", {})
    found = queries.QUERIES[name](spark, sf)
    found.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SortMergeJoin" not in plan
    base = sorted(tuple(r) for r in mapping.quads(spark, sf).collect())
    assert len({r[0] for r in queries._stored(spark, sf, *(("default", "by_copy") if len(columns) > 1 else ("typed_object" if columns == "p" else "default", "by_reference")))._read("base").selectExpr("rid >> 33").collect()}) > 5
    order = sorted(range(len(base)), key=lambda i: ([base[i]["spog".index(c)] for c in columns], i))
    want = [((*base[i], i, at) if len(columns) > 1 else (base[i]["spog".index(columns)], i, at)) for at, i in enumerate(order)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_adding_to_an_empty_store_looks_nothing_up(spark, monkeypatch, layout):
    """The quads are written once, and what a tail holds already isn't added again."""
    from sparkquads import store as module

    parts = []
    monkeypatch.setattr(module, "written", lambda df, path: parts.append(path) or df)
    monkeypatch.setattr(QuadStore, "_present", None)
    empty = QuadStore(spark, module.fresh(spark, "empty"), QuadStore._blank("", layout, (), "sorted_stream", 0) | {"base_rows": 0})
    store = empty.add(spark.createDataFrame([*example(9), *example(3)], QUADS))
    assert not parts and store.tail_len() == 9
    more = store.add(spark.createDataFrame(example(12), QUADS))
    assert more.tail_len() == 12 and rows(more._tail()) == Counter(example(12)) and more.add(spark.createDataFrame(example(5), QUADS)) is more
