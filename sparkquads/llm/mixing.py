"""Mixing sources to target weights by systematic sampling.

A source's expected copies per document bring its characters to its share of the total. The expected copies are
prefix-summed over the source's documents, a random offset in [0, 1) is added, and a document is emitted once for each
integer that its step of the sum crosses. Sums are integers, in millionths of a copy, so they are exact in any order.

The prefix sum is distributed: documents are range-partitioned by source and id and numbered by their partition's place
and their place in it, which gives each its place in its source without a window. Ranges are cut where the documents
are, so neither a large source nor ids far apart from the others bring much to one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ONE = 1_000_000
#: Without given weights a source weighs the power TEMPERATURE of its characters.
TEMPERATURE = 0.5
#: Copies of all characters together, in units of the input.
EPOCHS = 1.0
SEED = "mix-1"
#: Rows of a table of sources, or of sources by partition, up to which it is broadcast and not joined by a shuffle.
MOST_BROADCAST = 100_000


def _side(df: DataFrame, what: str) -> DataFrame:
    df = written(df, what)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _offset(source: Column, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(source, F.lit("null")))), 1, 13), 16, 10).cast("long") % ONE


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of docs as often as they are drawn, with a column copy from 1 on, which replaces any of that name.

    weights: target share by source, of any sum; a source that is not named, or null, then gets none. Without weights a
    source, the null one too, weighs its characters to the power TEMPERATURE. A document counts n_chars characters or,
    if that is null or there is no such column, its text's length, and 0 if both are null. The text too may be absent. A source without characters
    has no expected copies. Order within a source is by id, a null one first; rows of one id are ordered by their texts'
    hashes and repeated rows are drawn each for itself. An empty table stays empty.
    """
    names = {c.lower() for c in docs.columns}
    kept = docs.drop(*[c for c in docs.columns if c.lower() == "copy"])
    text = F.col("text").cast("string") if "text" in names else F.lit(None).cast("string")
    length = F.length(text)
    chars = F.coalesce(*([F.col("n_chars").cast("long")] if "n_chars" in names else []), length.cast("long"), F.lit(0))
    rows = kept.select(F.struct("*").alias("row"), F.xxhash64(text).alias("t"), F.col("doc_id").cast("long").alias("d"), F.col("source").cast("string").alias("s"), chars.alias("c"))
    stats = rows.groupBy("s").agg(F.sum("c").alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE))
    elif weights:
        named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        weight = F.coalesce(F.try_element_at(named, F.coalesce(F.col("s"), F.lit(""))), F.lit(0.0)) * F.when(F.col("s").isNull(), 0.0).otherwise(1.0)
    else:
        weight = F.lit(0.0)
    stats = stats.withColumn("w", F.when(F.col("size") > 0, weight).otherwise(0.0))
    total = stats.agg(F.sum("w").alias("all_w"), F.sum("size").alias("all_size"))
    stats = stats.crossJoin(F.broadcast(total)).select(  # one row
        F.col("s").alias("ss"),
        F.coalesce(F.round(F.lit(float(ONE) * epochs) * F.try_divide("w", "all_w") * F.try_divide(F.col("all_size").cast("double"), F.col("size").cast("double"))), F.lit(0.0)).cast("long").alias("e"),
    )
    # by source, id and text; equal rows, of which there may be very many, by where they were read
    order = ["s", "d", "t", "at"]
    rows = rows.select("row", "s", "d", "t", F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.select("row", "s", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "ordered")
    parts = rows.groupBy("s", "part").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low"))
    parts = parts.join(_side(stats, "sources"), F.col("s").eqNullSafe(F.col("ss"))).where("e > 0").select("ss", "part", "start", "e")
    rows = rows.join(_side(parts.withColumnRenamed("part", "pp"), "parts"), F.col("s").eqNullSafe(F.col("ss")) & (F.col("part") == F.col("pp")))
    reach = F.col("e") * (F.col("start") + F.col("place") + 1) + _offset(F.col("s"), seed)
    rows = rows.select("row", "e", reach.alias("reach"))
    copies = (F.expr(f"reach div {ONE}") - F.expr(f"(reach - e) div {ONE}")).cast("int")
    return rows.where(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies)).alias("copy")).select("row.*", "copy")


def oracle(seed: str = SEED, epochs: float = EPOCHS) -> str:
    """Of the query's columns, for TEMPERATURE."""
    return f"""
with d as (select doc_id, source, coalesce(n_chars, length(text), 0) c from documents),
s as (select source, sum(c)::double size from d group by source),
t as (select source, case when size > 0 then power(size, {TEMPERATURE}) else 0 end w, size from s),
r as (select source, round({float(ONE) * epochs} * (w / (select sum(w) from t)) * ((select sum(size) from t) / size))::bigint e,
        ('0x' || substr(md5('{seed}/' || coalesce(source, 'null')), 1, 13))::bigint % {ONE} u from t where size > 0),
p as (select d.doc_id, d.source, e, u + sum(e) over (partition by d.source order by d.doc_id rows between unbounded preceding and current row) reach
      from d join r on d.source is not distinct from r.source),
n as (select doc_id, source, (reach // {ONE} - (reach - e) // {ONE})::int n from p)
select doc_id, source, unnest(range(1, n + 1))::int copy from n where n > 0
"""


def offset(source: str, seed: str = SEED) -> int:
    return int(hashlib.md5(f"{seed}/{source}".encode()).hexdigest()[:13], 16) % ONE
