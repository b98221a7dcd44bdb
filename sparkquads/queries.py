"""The engine's own queries over the mapped tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms
from .operators import layouts
from .operators.bgp import basic_graph_pattern
from .plans.pattern import DEFAULT_GRAPH, Pattern
from .schema import QUAD, QUADS, XSD
from .sources import mapping, rdf_text
from .sources.mapping import TYPE, X
from .storage import fresh
from .store import QuadStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_Q = f"with q as ({mapping.sql()})"
#: A quad of the tables that all positions of a pattern are bound to.
PROBE = {"s": f"<{X}customer/17>", "p": f"<{X}customer#nation>", "o": f"<{X}nation/3>", "g": f"<{X}graph/customer>"}
NATION, THIRD = PROBE["p"], PROBE["o"]
LITERAL_SQL = r"(?s)^\"(.*)\"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$".replace('\\"', '"')


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _quads(spark: SparkSession, d: str) -> DataFrame:
    return mapping.quads(spark, d)


def _where(pattern: dict[str, str]) -> str:
    return " and ".join(f"{c} = '{x}'" for c, x in pattern.items()) or "true"


def _match(spark: SparkSession, d: str, **bound) -> DataFrame:
    return _stored(spark, d).match(**bound).quads()


_STORES: dict[tuple, QuadStore] = {}


def _stored(spark: SparkSession, d: str, layout: str = "default", *indexes: str) -> QuadStore:
    """A store of all quads of the tables, built once for each session."""
    key = (spark.sparkContext.applicationId, d, layout, indexes)
    if key not in _STORES:
        _STORES[key] = QuadStore.build(_quads(spark, d), layout=layout, indexes=indexes)
    return _STORES[key]


@query(f"{_Q} select * from q")
def scan_all(spark, d):
    return _quads(spark, d)


#: Stores that all shapes of patterns are put to.
STORES = {"match": ("default",), "typed_match": ("typed_object", "by_reference"), "coded_match": ("dictionary", "by_copy")}


def _shapes() -> None:
    for prefix, store in STORES.items():
        for n in range(5):
            for cs in combinations(QUAD, n):
                bound = {c: PROBE[c] for c in cs}
                query(f"{_Q} select * from q where {_where(bound)}", f"{prefix}_{''.join(cs) or 'all'}")(lambda s, d, b=bound, x=store: _stored(s, d, *x).match(**b).quads())


_shapes()


@query(f"{_Q} select * from q where g = ''")
def match_default_graph(spark, d):
    return _match(spark, d, g=DEFAULT_GRAPH)


@query(f"{_Q} select * from q where false")
def match_miss(spark, d):
    """Through a dictionary that lacks the term: no row of the base is read."""
    return QuadStore.build(_quads(spark, d), layout="dictionary").match(p="http://ex.org/none").quads()


@query(f"{_Q} select * from q where o = '\"BUILDING\"@en'")
def match_language(spark, d):
    return _match(spark, d, o='"BUILDING"@en')


@query(f"{_Q} select * from q where {_where({'p': NATION, 'o': THIRD})}")
def match_chained(spark, d):
    return QuadStore.build(_quads(spark, d)).match(p=NATION).match(o=THIRD).quads()


@query(f"{_Q} select * from q where o = '\"BUILDING\"@en'")
def match_typed_object(spark, d):
    return QuadStore.build(_quads(spark, d), layout="typed_object").match(o='"BUILDING"@en').quads()


@query(f"{_Q} select s, p, o from q where o = '{THIRD}'")
def match_triples(spark, d):
    return QuadStore.build(_quads(spark, d), layout="dictionary", indexes=["by_copy"]).match(o=THIRD).triples()


_M = f"{_Q}, m as (select * from q where p = '{NATION}')"


@query(f"{_M}, t as (select s term from m union select p from m union select o from m), k as (select (row_number() over (order by term) - 1)::bigint id, term from t) select * from k")
def match_compact_ids(spark, d):
    return _stored(spark, d).match(p=NATION).compact_result()[0]


@query(f"""{_M}, t as (select s term from m union select p from m union select o from m), k as (select (row_number() over (order by term) - 1)::bigint id, term from t)
select a.id s, b.id p, c.id o from m join k a on m.s = a.term join k b on m.p = b.term join k c on m.o = c.term""")
def match_compact_triples(spark, d):
    return _stored(spark, d, "dictionary", "by_copy").match(p=NATION).compact_result()[1]


@query(f"{_Q}, m as (select * from q where p = '{NATION}') select s as term from m union select p from m union select o from m")
def match_compact_terms(spark, d):
    return QuadStore.build(_quads(spark, d)).match(p=NATION).compact_result()[0].select("term")


_DICT = f"{_Q}, t as (select s term from q union select p from q union select o from q union select g from q), k as (select (row_number() over (order by term) - 1)::bigint code, term from t)"
_CODES = "select a.code s, b.code p, c.code o, e.code g from q join k a on q.s = a.term join k b on q.p = b.term join k c on q.o = c.term join k e on q.g = e.term"


@query(f"{_DICT} {_CODES} where q.p = '{NATION}'")
def match_codes(spark, d):
    return QuadStore.build(_quads(spark, d), layout="dictionary").match(p=NATION).codes()


@query(f"{_DICT} select * from k")
def dict_build(spark, d):
    return layouts.dictionary(_quads(spark, d))


@query(f"{_DICT} {_CODES}")
def dict_encode(spark, d):
    words = layouts.dictionary(_quads(spark, d))
    return layouts.encoded(_quads(spark, d), words, words.count())


@query(f"{_Q} select * from q")
def dict_decode(spark, d):
    return QuadStore.build(_quads(spark, d), layout="dictionary").quads()


@query(f"{_DICT} select code from k where term = '{THIRD}'")
def encode_term(spark, d):
    return spark.createDataFrame([(_stored(spark, d, "dictionary", "by_copy").encode_term(THIRD),)], "code long")


@query(f"{_Q} select (count(*) > 0) found from q where {_where(PROBE)}")
def contains(spark, d):
    return spark.createDataFrame([(_stored(spark, d).contains(*PROBE.values()),)], "found boolean")


@query(f"{_Q} select count(*)::bigint n from q")
def size(spark, d):
    return spark.createDataFrame([(_stored(spark, d, "typed_object", "by_reference").size(),)], "n long")


@query(f"{_Q} select count(*)::bigint n from q where p = '{NATION}'")
def size_filtered(spark, d):
    return spark.createDataFrame([(_stored(spark, d, "dictionary", "by_copy").match(p=NATION).size(),)], "n long")


_L = f"regexp_extract(o, '{LITERAL_SQL}', %d)"
_KIND = f"case when o like '<%' then 0 when o like '\\_:%' escape '\\' then 1 when {_L % 2} <> '' then 3 when {_L % 3} <> '' and {_L % 3} <> '{XSD}string' then 4 else 2 end"
_LEX = f"replace(replace(replace(replace(replace({_L % 1}, chr(92) || chr(92), chr(1)), chr(92) || '\"', '\"'), chr(92) || 'n', chr(10)), chr(92) || 'r', chr(13)), chr(1), chr(92))"


@query(f"""{_Q}, k as (select *, {_KIND} kind from q) select s, p, kind::int o_kind,
case kind when 0 then substr(o, 2, length(o) - 2) when 1 then substr(o, 3) else {_LEX} end o_value,
case when kind = 4 then {_L % 3} end o_datatype, case when kind = 3 then {_L % 2} end o_lang, g from k""")
def typed_decompose(spark, d):
    return layouts.typed_objects(_quads(spark, d))


@query(f"{_Q} select * from q")
def typed_compose(spark, d):
    return layouts.plain_objects(layouts.typed_objects(_quads(spark, d)))


@query(f"{_Q} select distinct o as term, {_LEX} as lexical, nullif({_L % 2}, '') lang, nullif({_L % 3}, '') datatype from q where o like '\"%'")
def literal_parts(spark, d):
    part = lambda i: F.regexp_extract("term", terms.LITERAL, i)
    found = _quads(spark, d).where(F.col("o").startswith('"')).select(F.col("o").alias("term")).distinct()
    return found.select("term", terms.unescaped(part(1)).alias("lexical"), F.nullif(part(2), F.lit("")).alias("lang"), F.nullif(part(3), F.lit("")).alias("datatype"))


_RIDS = f"{_Q}, r as (select *, (row_number() over (order by s, p, o, g) - 1)::bigint rid from q)"


def _numbered(df: DataFrame, part: Column, row: Column, name: str, rows: DataFrame | None = None) -> DataFrame:
    """With the place, from 0, of each row among those of `rows`, by the sizes of the parts before its own and its place
    in this. The driver gets a number for each part, and no row is moved."""
    sizes = (df if rows is None else rows).groupBy(part.alias("part")).count().collect()
    sizes.sort(key=lambda r: (len(r["part"]), r["part"]) if isinstance(r["part"], str) else r["part"])
    offsets = [(r["part"], n) for r, n in zip(sizes, accumulate((x["count"] for x in sizes), initial=0))]
    kind = "string" if sizes and isinstance(sizes[0]["part"], str) else "long"
    found = df.withColumns({"_part": part, name: row})
    return found.join(F.broadcast(df.sparkSession.createDataFrame(offsets, f"_part {kind}, _off long")), "_part").withColumn(name, F.col(name) + F.col("_off")).drop("_part", "_off")


def _in_files(df: DataFrame, name: str) -> DataFrame:
    """With the place, from 0, at which a row lies in a store's files, as they are ordered by name."""
    return _numbered(df, F.col("_metadata.file_name"), F.col("_metadata.row_index"), name)


def _rids(spark: SparkSession, d: str, index: str, name: str, layout: str = "default") -> DataFrame:
    """A table of a store with the place of its row ids among all, as ids leave gaps between partitions."""
    store = _stored(spark, d, layout, index)
    part = F.shiftright("rid", 33)  # of monotonically_increasing_id(), the row in the partition below
    return _numbered(_in_files(store._read(name), "place"), part, F.col("rid") - F.shiftleft(part, 33), "dense", store._read("base")).drop("rid").withColumnRenamed("dense", "rid")


@query(f"{_RIDS} select * from r")
def sorted_rids(spark, d):
    """As the base lies in its files."""
    return _in_files(_stored(spark, d)._read("base"), "place").select(*QUAD, F.col("place").alias("rid"))


@query(f"{_RIDS} select s, p, o, g, rid, (row_number() over (order by p, o, s, g) - 1)::bigint place from r")
def index_posg(spark, d):
    return _rids(spark, d, "by_copy", "posg").select(*QUAD, "rid", "place")


@query(f"{_RIDS} select s, p, o, g, rid, (row_number() over (order by o, s, p, g) - 1)::bigint place from r")
def index_ospg(spark, d):
    return _rids(spark, d, "by_copy", "ospg").select(*QUAD, "rid", "place")


@query(f"{_RIDS} select o val, rid, (row_number() over (order by o, rid) - 1)::bigint place from r")
def index_ref_o(spark, d):
    return _rids(spark, d, "by_reference", "ref_o").select("val", "rid", "place")


@query(f"{_RIDS} select p val, rid, (row_number() over (order by p, rid) - 1)::bigint place from r")
def index_ref_p(spark, d):
    return _rids(spark, d, "by_reference", "ref_p", "typed_object").select("val", "rid", "place")


@query(f"{_RIDS} select rid from r where o = '{THIRD}'")
def index_probe_rids(spark, d):
    return _rids(spark, d, "by_reference", "ref_o").where(F.col("val") == THIRD).select("rid")


@query(f"{_Q} select * from q where o = '{THIRD}'")
def match_via_ref_index(spark, d):
    return QuadStore.build(_quads(spark, d), indexes=["by_reference"]).match(o=THIRD).quads()


@query(f"{_Q} select * from q where {_where({'p': NATION, 'o': THIRD})}")
def match_via_copy_index(spark, d):
    return QuadStore.build(_quads(spark, d), layout="dictionary", indexes=["by_copy"]).match(p=NATION, o=THIRD).quads()


#: One quad that is there, two alike that are not, and one more.
NEW = [tuple(PROBE.values()), *[(f"<{X}customer/new>", NATION, THIRD, "")] * 2, (f"<{X}customer/new>", TYPE, f"<{X}Customer>", "")]
_NEW = "n(s, p, o, g) as (values " + ", ".join("(" + ", ".join(f"'{x}'" for x in q) + ")" for q in NEW) + ")"


@query(f"{_Q}, {_NEW} select * from q union all select * from (select distinct * from n) x anti join q using (s, p, o, g)")
def add_quads(spark, d):
    return QuadStore.build(_quads(spark, d)).add(NEW).quads()


@query(f"{_Q}, {_NEW}, a as (select * from q union all select * from (select distinct * from n) x anti join q using (s, p, o, g)) select * from a where o = '{THIRD}'")
def match_with_tail(spark, d):
    return QuadStore.build(_quads(spark, d), layout="dictionary", indexes=["by_copy"]).add(NEW).match(o=THIRD).quads()


@query(f"{_Q} select * from q where not ({_where(PROBE)})")
def delete_quad(spark, d):
    return QuadStore.build(_quads(spark, d)).delete_quad(*PROBE.values()).quads()


@query(f"{_Q} select * from q where not ({_where({'p': NATION, 'o': THIRD})})")
def delete_matching(spark, d):
    return QuadStore.build(_quads(spark, d), indexes=["by_reference"]).delete(p=NATION, o=THIRD).quads()


_READDED = f"{_Q}, {_NEW} select * from q where not ({_where({'p': NATION})}) union all select distinct * from n where p = '{NATION}'"


@query(_READDED)
def readd_after_delete(spark, d):
    return QuadStore.build(_quads(spark, d)).delete(p=NATION).add([q for q in NEW if q[1] == NATION]).quads()


@query(_READDED)
def compact(spark, d):
    store = QuadStore.build(_quads(spark, d), layout="dictionary", indexes=["by_copy"]).delete(p=NATION).add([q for q in NEW if q[1] == NATION])
    return store.compact().quads()


_ITEMS = f"d as (select '<{X}lineitem/' || l_orderkey || '-' || l_linenumber || '>' s, '<{X}lineitem#part>' p, '<{X}part/' || l_partkey || '>' o, '' g from lineitem union all select '<{X}item/' || l_linenumber || '>', '<{X}item#flag>', '\"' || l_returnflag || '\"', '' from lineitem)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Quads with many duplicates."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    text = lambda *xs: F.concat(*[F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for i, x in enumerate(xs)])
    a = t.select(text(f"<{X}lineitem/", "l_orderkey", "-", "l_linenumber", ">").alias("s"), F.lit(f"<{X}lineitem#part>").alias("p"), text(f"<{X}part/", "l_partkey", ">").alias("o"), F.lit("").alias("g"))
    b = t.select(text(f"<{X}item/", "l_linenumber", ">").alias("s"), F.lit(f"<{X}item#flag>").alias("p"), text('"', "l_returnflag", '"').alias("o"), F.lit("").alias("g"))
    return a.unionByName(b)


@query(f"with {_ITEMS} select * from d")
def duplicates_kept(spark, d):
    return QuadStore.build(_items(spark, d), layout="dictionary").quads()


@query(f"with {_ITEMS} select * from d where not (s = '<{X}item/1>' and o = '\"R\"')")
def duplicates_deleted(spark, d):
    return QuadStore.build(_items(spark, d)).delete_quad(f"<{X}item/1>", f"<{X}item#flag>", '"R"').quads()


@query(f"{_Q} select concat_ws(' ', s, p, o, nullif(g, ''), '.') as line from q")
def to_nquads(spark, d):
    return _quads(spark, d).select(rdf_text.line().alias("line"))


@query(f"{_Q} select * from q")
def parse_nquads(spark, d):
    path = fresh(spark, "nquads")
    rdf_text.write(_quads(spark, d), path, "nq")
    return rdf_text.read(spark, path, "nq")


_ESC = f"""with n as (select '<{X}' || chr(233) || chr(128512) || '/' || n_nationkey || '>' s, '<{X}p' || chr(233) || '>' p,
'"' || n_name || chr(233) || '\\n\\\\"^^<{X}d' || chr(233) || '>' o, '<{X}g' || chr(233) || '>' g from nation)"""


def _escaped(spark: SparkSession, d: str) -> DataFrame:
    """Lines with escapes in all four positions and in a datatype."""
    t = spark.read.parquet(f"{d}/nation.parquet")
    line = F.concat(
        F.lit(f"<{X}\\u00e9\\U0001F600/"), F.col("n_nationkey").cast("string"), F.lit(f"> <{X}p\\u00E9> \""), "n_name", F.lit(f"\\u00e9\\n\\\\\"^^<{X}d\\u00e9> <{X}g\\U000000e9> . # a comment")
    )
    return rdf_text.parsed(t.select(line.alias("value")))


@query(f"{_ESC} select * from n")
def parse_escaped_iris(spark, d):
    return _escaped(spark, d)


@query(f"{_ESC} select * from n where s = '<{X}' || chr(233) || chr(128512) || '/3>'")
def match_escaped_iri(spark, d):
    """Found by its characters; the graph is bound by its escapes."""
    return QuadStore.build(_escaped(spark, d), layout="dictionary").match(s=f"{X}\u00e9\U0001F600/3", g=f"<{X}g\\u00e9>").quads()


@query(f"{_Q} select * from q")
def arrow_bytes(spark, d):
    """Through Arrow IPC and back, with the dictionary behind the codes."""
    return QuadStore.read_bytes(spark, _stored(spark, d, "dictionary", "by_copy").write_bytes()).quads()


@query(f"{_Q} select * from q where o = '\"BUILDING\"@en'")
def arrow_bytes_typed(spark, d):
    return QuadStore.read_bytes(spark, _stored(spark, d, "typed_object", "by_reference").write_bytes()).match(o='"BUILDING"@en').quads()


@query(f"{_Q} select * from q where {_where({'p': NATION, 'o': THIRD})}")
def match_loaded(spark, d):
    """Of a store held in memory."""
    store = QuadStore.load(spark, _stored(spark, d).path)
    return store.match(p=NATION, o=THIRD).quads()


@query(f"{_Q} select * from q where o = '{THIRD}'")
def match_not_resident(spark, d):
    """With a dictionary that is never broadcast."""
    return QuadStore.open(spark, _stored(spark, d, "dictionary", "by_copy").path, resident_terms=0).match(o=THIRD).quads()


@query(f"{_Q} select * from q")
def decode_not_resident(spark, d):
    return QuadStore.open(spark, _stored(spark, d, "dictionary", "by_copy").path, resident_terms=0).quads()


@query("with i as (select range i from range(100000)) select '<http://example.org/subject/' || i || '>' s, '<http://example.org/predicate/' || i % 100 || '>' p, '<http://example.org/object/' || i % 50 || '>' o, '<http://example.org/graph/' || i % 10 || '>' g from i")
def gen_scan(spark, d):
    return rdf_text.generated(spark, 100_000)


@query(f"""{_Q} select a.s customer, b.o region, c.o name from q a join q b on a.o = b.s join q c on a.o = c.s
where a.p = '{NATION}' and b.p = '<{X}nation#region>' and c.p = '<{X}nation#name>'""")
def bgp_join(spark, d):
    quads = _quads(spark, d)
    return basic_graph_pattern(lambda p: quads.where(p.condition()), [("?customer", NATION, "?n"), ("?n", f"<{X}nation#region>", "?region"), ("?n", f"<{X}nation#name>", "?name")]).select("customer", "region", "name")


def _streamed(spark: SparkSession, d: str) -> QuadStore:
    """All quads as N-Quads files, added to an empty store by a stream."""
    from .streaming.ingest import ingest

    source = fresh(spark, "lines")
    rdf_text.write(_quads(spark, d), source, "nq")
    store = QuadStore.empty(spark)
    ingest(spark, source, store, fresh(spark, "offsets")).awaitTermination()
    return QuadStore.open(spark, store.path)


@query()
def stream_ingest(spark, d):
    """All quads pass the stream; of the store, those of one predicate."""
    return _streamed(spark, d).match(p=NATION).quads()


@query(f"{_Q} select distinct * from q")
def stream_ingest_all(spark, d):
    """All quads pass the stream, and all of the store are compared; adding has set semantics."""
    return _streamed(spark, d).quads()


SQL["stream_ingest"] = f"{_Q} select * from q where p = '{NATION}'"
__all__ = ["QUERIES", "SQL", "QUADS"]
