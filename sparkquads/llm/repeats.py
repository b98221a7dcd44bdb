"""Common to both kinds of substring dedup: where repeated passages can be, and the spans that they cover.

A passage is LENGTH words. Two documents that share it share a phrase of PHRASE words at a sampled position in its
first LENGTH - PHRASE + 1 words: the sample (closed syncmers) depends on the phrase alone. So phrases that occur in two
documents are found first, by hash, and only texts around these go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import from_ids, ids, slices, written
from .words import U, Words, anchors, mix

LENGTH, PHRASE, SMALL = 50, 27, 3
#: Words before a sampled phrase at which a passage that holds it may start.
BACK = LENGTH - PHRASE
#: Documents that may hold a phrase for its places to be compared in one task.
HOT = 20_000
#: Partitions of an exchange at most; shards and buckets grow in number beyond it, and a task takes several in turn.
MOST_TASKS = 16_384
SPANS = "d long, start long, stop long"


def candidates(docs: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """(d, text, phrases) of each document with phrases that occur in other documents too, phrases being their sorted
    hashes; how many (document, phrase) there are; and the spans (d, start, stop) around phrases that more than HOT
    documents hold, which are in neither: they are found without gathering the places of a phrase anywhere."""
    slim = docs.select(ids("doc_id").alias("d"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("t", F.xxhash64("text"))

    def sample(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words.of(part.column(1))
                at, h = anchors(words, PHRASE, SMALL)
                row = words.doc[at]
                pairs = np.unique(np.rec.fromarrays([h.view(np.int64), row], names="h,r"))
                yield pa.RecordBatch.from_arrays([pa.array(pairs.h), *(part.column(c).take(pa.array(pairs.r)) for c in (0, 2))], ["h", "d", "t"])

    found = written(slim.mapInArrow(sample, "h long, d long, t long"), "phrases")
    shared = found.groupBy("h").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("n")).where("a < b").select("h", (F.col("n") > HOT).alias("hot"))
    # the phrases that recur, against all places: AQE splits a phrase that very many documents hold
    places = written(found.join(shared, "h"), "places")
    counted = {r.hot: r.n for r in places.groupBy("hot").agg(F.count("*").alias("n")).collect()}  # two rows

    def having(hot: bool) -> DataFrame:
        # by text as well as id, as very many documents may have no id
        lists = places.where(F.col("hot") == hot).groupBy("d", "t").agg(F.array_sort(F.collect_set("h")).alias("phrases"))
        return slim.join(lists, ["d", "t"]).select("d", "text", "phrases")

    hot = _hot_spans(having(True)) if counted.get(True) else docs.sparkSession.createDataFrame([], SPANS)
    return having(False), counted.get(False, 0), hot


def _hot_spans(texts: DataFrame) -> DataFrame:
    """Spans of passages that hold one of the phrases of (d, text, phrases), by grouping the hashes of all of these
    passages, two of 64 bits, with partial aggregation."""

    def passages(batches):
        for batch in batches:
            for part in slices(batch):
                words, at, _ = around(part)
                start = np.unique((at[:, None] - np.arange(BACK + 1)[None, :]).ravel())
                start = start[(start >= 0) & (start <= len(words) - LENGTH)]
                start = start[words.whole(LENGTH)[start]]
                row = words.doc[start]
                a = words.grams(LENGTH)[start]
                b = combined(words.grams(PHRASE)[start], words.grams(BACK)[start + PHRASE])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(start - words.first[row])], ["a", "b", "d", "start"])

    rows = written(texts.mapInArrow(passages, "a long, b long, d long, start long"), "hot")
    again = rows.groupBy("a", "b").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high").select("a", "b")
    return rows.join(again, ["a", "b"], "left_semi").select("d", "start", (F.col("start") + LENGTH).alias("stop"))


def around(part: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
    """Of rows (d, text, phrases): the words, the numbers of those that start a recurring phrase, its hashes."""
    words = Words.of(part.column(1))
    at, h = anchors(words, PHRASE, SMALL)
    lists = part.column(2)
    known = np.unique(np.asarray(lists.flatten())).view(U)
    keep = np.isin(h, known)  # of any document here: a few more places, which the comparison drops
    return words, at[keep], h[keep]


def repeated(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row, whether its group has rows of two documents or more."""
    if not len(group):
        return np.zeros(0, bool)
    order = np.argsort(group, kind="stable")
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    d = doc[order]
    several = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
    out = np.empty(len(g), bool)
    out[order] = np.repeat(several, np.diff(np.r_[starts, len(g)]))
    return out


def intervals(doc: np.ndarray, at: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    """Spans (d, start, stop) of the passages that start d words before `at`, for each d with flags[d]."""
    n = len(at)
    wide = np.zeros((n, BACK + 3), np.int8)
    wide[:, 1:-1] = flags.T
    step = np.diff(wide, axis=1)
    row, low = np.nonzero(step == 1)  # of d
    _, high = np.nonzero(step == -1)
    spans = np.unique(np.rec.fromarrays([doc[row], at[row] - high + 1, at[row] - low + LENGTH], names="d,a,b"))
    if len(spans):  # merge what touches, per document
        top = np.maximum.accumulate(spans.b + (np.cumsum(np.r_[0, spans.d[1:] != spans.d[:-1]]).astype(np.int64) << 32))
        rank = np.cumsum(np.r_[0, spans.d[1:] != spans.d[:-1]]).astype(np.int64) << 32
        new = np.r_[True, spans.a[1:] + rank[1:] > top[:-1]]
        first = np.flatnonzero(new)
        stop = (top - rank)[np.r_[first[1:] - 1, len(spans) - 1]]
        cols = [spans.d[first], spans.a[first], stop]
    else:
        cols = [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], ["d", "start", "stop"])


def merged(spans: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word): spans that touch or overlap become one. Of those that start together one goes on,
    so a document, or all those without an id, brings no more rows than a text has words."""
    spans = spans.groupBy("d", "start").agg(F.max("stop").alias("stop"))
    w = Window.partitionBy("d").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
    numbered = marked.withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("d", "k").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"))
    return out.select(from_ids("d").alias("doc_id"), "start_word", "end_word")


def hash_windows(words: Words, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on, 0 where they reach beyond their text."""
    out = np.zeros(len(words), U)
    whole = words.whole(size)
    out[: len(whole)][whole] = words.grams(size)[whole]
    return out


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(U) * U(0x9E3779B97F4A7C15) + mix(b))


ORACLE = f"""
with w as (select doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') w from documents),
p as (select doc_id, i, array_to_string(w[i + 1:i + {LENGTH}], ' ') g
      from (select *, unnest(range(0, len(w) - {LENGTH} + 1)) i from w where len(w) >= {LENGTH})),
r as (select g from p group by g having min(doc_id) < max(doc_id)),
s as (select doc_id, i, i + {LENGTH} e from p semi join r using (g)),
m as (select *, case when max(e) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) >= i then 0 else 1 end n from s),
k as (select *, sum(n) over (partition by doc_id order by i rows between unbounded preceding and current row) k from m)
select doc_id, min(i)::bigint start_word, max(e)::bigint end_word from k group by doc_id, k
"""
