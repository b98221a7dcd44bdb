"""Line dedup over overlapping windows of three lines.

Each three consecutive lines are hashed to 128 bits, recurring windows are found globally, and every occurrence but the
first covers its three lines. Covered lines, merged to runs, go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import from_ids, ids, written

WIDTH = 3
SOLID = "[^ \\t\\n\\r\\f\\x0B]"


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lines_removed) of every row of docs, without the lines of windows that occurred before.

    Lines end at \\n and are compared as they are; a window of blank lines alone never counts. The order is by doc_id, a
    null one first, and by place. Null texts stay null and texts of fewer than three lines stay as they are; a text of
    which all lines go becomes empty. Repeated rows are one document and come back alike, each as often as it came; rows
    of one doc_id with other texts are documents of their own, in the order of their texts' hashes. Other columns are
    not read.
    """
    rows = docs.select(ids("doc_id").alias("d"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("t", F.coalesce(F.xxhash64("text"), F.lit(0)))

    def window(ls, i):
        a, b, c = (F.get(ls, i + k) for k in range(WIDTH))
        solid = F.concat(a, b, c).rlike(SOLID)
        return F.struct(i.alias("p"), F.when(solid, F.xxhash64(a, b, c)).alias("h"), F.xxhash64(c, F.lit(1), b, a).alias("g"))

    # bound as a variable, the lines are split once
    places = lambda ls: F.when(F.size(ls) >= WIDTH, F.transform(F.sequence(F.lit(0), F.greatest(F.size(ls) - WIDTH, F.lit(0))), lambda i: window(ls, i)))
    windows = rows.select("d", "t", F.inline(F.get(F.transform(F.array(F.split("text", "\n")), places), 0))).where("h is not null")
    windows = written(windows, "windows")
    first = windows.groupBy("h", "g").agg(F.min(F.struct("d", "t", "p")).alias("f"), F.max(F.struct("d", "t", "p")).alias("last"))
    later = windows.join(first.where("f < last").select("h", "g", "f"), ["h", "g"]).where(F.struct("d", "t", "p") > F.col("f"))
    w = Window.partitionBy("d", "t").orderBy("p")
    cut = later.select("d", "t", "p").distinct()  # of repeated rows
    cut = cut.withColumn("new", F.when(F.col("p") <= F.lag("p").over(w) + WIDTH, 0).otherwise(1)).withColumn("k", F.sum("new").over(w))
    runs = cut.groupBy("d", "t", "k").agg(F.min("p").alias("a"), (F.max("p") + WIDTH).alias("b"))
    runs = runs.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))
    end = F.element_at("runs", -1)["b"]

    def rest(ls):
        last = lambda i: F.coalesce(F.get(F.col("runs"), i - 1)["b"], F.lit(0))
        before = F.transform("runs", lambda r, i: F.slice(ls, last(i) + 1, r["a"] - last(i)))
        return F.array_join(F.concat(F.flatten(before), F.slice(ls, end + 1, F.greatest(F.size(ls) - end, F.lit(0)))), "\n")

    kept = F.get(F.transform(F.array(F.split("text", "\n")), rest), 0)
    gone = F.aggregate("runs", F.lit(0), lambda n, r: n + r["b"] - r["a"])
    return rows.join(runs, ["d", "t"], "left").select(
        from_ids("d").alias("doc_id"),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("lines_removed"),
    )


ORACLE = f"""
with l as (select doc_id, text, string_split(text, chr(10)) ls from documents),
w as (select doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] g
      from (select *, unnest(range(0, len(ls) - {WIDTH - 1})) i from l where len(ls) >= {WIDTH})),
f as (select *, row_number() over (partition by g order by doc_id, i) n from w where regexp_matches(g, '{SOLID}')),
x as (select doc_id, list(p) ps from (select distinct doc_id, i + k p from f, (values (0), (1), (2)) v(k) where n > 1) group by doc_id)
select doc_id, case when ps is null then text else array_to_string(list_filter(ls, lambda x, i: not list_contains(ps, i - 1)), chr(10)) end as text,
  coalesce(len(ps), 0)::bigint lines_removed
from l left join x using (doc_id)
"""
