from collections import Counter

from sparkquads import QuadStore, queries
from sparkquads.sources import mapping

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_all_quads_pass_the_stream(spark, monkeypatch):
    made, empty = [], QuadStore.empty
    monkeypatch.setattr(QuadStore, "empty", lambda *a, **kw: made.append(empty(*a, **kw)) or made[-1])
    want = Counter(set(rows(mapping.quads(spark, SF))))
    got = rows(queries.QUERIES["stream_ingest"](spark, SF))
    store = QuadStore.open(spark, made[0].path)
    assert rows(store.quads()) == want and len(want) > 4_096
    assert store.tail_len() == 0 and store.manifest["base_rows"] == len(want)  # compacted
    assert got == Counter(q for q in want if q[1] == queries.NATION)
    assert rows(queries.QUERIES["stream_ingest_all"](spark, SF)) == want
