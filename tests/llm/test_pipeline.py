import corpus_pipeline
from sparkquads.llm import hashtree
from sparkquads.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixture", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = docs.cache()
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= seen and len(now) > 0.5 * len(seen), name
        seen = now
        assert docs.columns == columns + (list(hashtree.LEVELS) if name == "sharding" else [])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_awkward_tables(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns named like those inside the stages."""
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the same", None, "s", None), (2, "the same", None, "s", None), (3, long, "de", None, 5), (4, long + " more", "de", "s", 6), (None, "the one", "en", "s", 7), (5, "und die", "de", "t", -1)]
    extra = [f"{c} string" for c in ("row", "d", "t", "k", "e", "part", "place", "found", "keep", "language", "copy", "region", "shard", "at")]
    docs = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *extra]))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.columns == list(corpus_pipeline.COLUMNS) + (list(hashtree.LEVELS) if name == "sharding" else [])
        left[name] = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    everything = sorted((i or 0, t or "") for i, t, *_ in rows)
    assert left["decontamination"] == left["sharding"] == everything
    assert (0, "") not in left["language_id"] and (1, "") not in left["language_id"]
    assert left["near_dedup"] == [(0, ""), (0, "the one"), (1, ""), (2, "the same"), (3, long), (5, "und die")]
    assert {i for i, _ in left["mixture"]} <= {i for i, _ in everything}


def test_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
