"""Encoding of quads in each layout and back."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.terms import composed, cut, typed_columns
from ..schema import QUAD
from ..storage import dense_ranks, fresh, parts, written

#: Terms up to which a dictionary is broadcast to the tasks that encode or decode, unless told otherwise.
MOST_BROADCAST_TERMS = 1 << 20


def typed_objects(quads: DataFrame) -> DataFrame:
    o = typed_columns(F.col("o"), F.col("_cut"))
    return quads.withColumn("_cut", cut(F.col("o"))).select("s", "p", *(c.alias(k) for k, c in o.items()), "g", *[c for c in quads.columns if c not in QUAD])


def plain_objects(typed: DataFrame) -> DataFrame:
    o = composed(F.col("o_kind"), F.col("o_value"), F.col("o_datatype"), F.col("o_lang"))
    return typed.select("s", "p", o.alias("o"), "g", *[c for c in typed.columns if c not in ("s", "p", "g", "o_kind", "o_value", "o_datatype", "o_lang")])


def dictionary(quads: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(code, term) of all distinct terms; a code is the place of the term among all, sorted by bytes. The pairs of
    predicate and graph, if they are known, spare most of the rows that these make."""
    found = quads.select(F.explode(F.array(*(QUAD if pairs is None else "so"))).alias("term"))
    if pairs is not None:
        found = found.union(pairs.select(F.explode(F.array("p", "g"))))
    distinct = found.distinct()
    distinct = written(distinct, fresh(quads.sparkSession, "distinct"))
    return dense_ranks(distinct, ["term"], "code", fresh(quads.sparkSession, "terms"), distinct.count()).select("code", "term")


def _side(terms: DataFrame, count: int, most: int) -> DataFrame:
    return F.broadcast(terms) if count <= most else terms


def of_position(quads: DataFrame, terms: DataFrame, key: str, column: str) -> DataFrame:
    """The part of a dictionary that a position needs; key is the dictionary's column that the position holds."""
    some = quads.select(F.col(column).alias("_k")).distinct()
    some = written(some, fresh(quads.sparkSession, f"keys_{column}"))
    if some.count() <= MOST_BROADCAST_TERMS:
        some = F.broadcast(some)
    return terms.join(some, F.col(key) == F.col("_k"), "left_semi")


#: Rows of the sample that tells hot values, and how often one is in it.
SAMPLE, HOT = 1 << 18, 32


def tied(quads: DataFrame) -> DataFrame:
    """With a number that spreads equal rows, made where the rows are read, in their order."""
    return quads.withColumn("_tie", (F.monotonically_increasing_id() % 4096).cast("short"))


def hot_values(quads: DataFrame, columns: Iterable[str], rows: int) -> dict[str, list]:
    """Values that very many rows have, at most SAMPLE / HOT of a column; found in a sample, as only the spread of work
    rests on it."""
    if not (columns := list(columns)):
        return {}
    some = quads.select(*columns).sample(min(1.0, SAMPLE / max(rows, 1)), 7) if rows > SAMPLE else quads.select(*columns)
    values = some.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in columns))).alias("v")).select("v.*")
    found = values.groupBy("c", "x").count().where(F.col("count") >= HOT).collect()  # SAMPLE / HOT of a column at most, as so many fit
    return {c: [r["x"] for r in found if r["c"] == c] for c in columns}


def _joined(quads: DataFrame, column: str, terms: DataFrame, key: str, value: str, rows: int, count: int, hot: list, spread: Column | None) -> DataFrame:
    """quads with the dictionary's value for a column as _v, null if it has none, by a shuffle into parts of bounded size.

    A part of the dictionary is hashed, so that no quads are sorted. Rows with a hot value get it by a broadcast and are
    shuffled by `spread`, which is no key of the dictionary."""
    spark = quads.sparkSession
    n = max(parts(spark, rows), parts(spark, 4 * count))  # a hashed part can't be spilled, so it is smaller
    sides = terms.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    at = column
    if hot:
        kind = terms.schema[key].dataType
        few = F.broadcast(spark.createDataFrame([(x,) for x in hot], StructType([StructField("_h", kind)])))
        few = sides.join(few, F.col("_k") == F.col("_h"), "left_semi").select(F.col("_k").alias("_h"), F.col("_v").alias("_w"))
        quads = quads.join(F.broadcast(few), F.col(column) == F.col("_h"), "left").drop("_h")
        quads, at = quads.withColumn("_j", F.when(F.col("_w").isNull(), F.col(column)).otherwise(spread)), "_j"
    out = quads.repartition(n, at).join(sides.repartition(n, "_k").hint("shuffle_hash"), F.col(at) == F.col("_k"), "left")
    return (out.withColumn("_v", F.coalesce("_w", "_v")) if hot else out).drop("_k", "_w", "_j")


def encoded(quads: DataFrame, terms: DataFrame, count: int, most: int | None = None, rows: int | None = None, few: dict[str, DataFrame] | None = None, hot: dict[str, list] | None = None) -> DataFrame:
    """Terms by their codes. A term that the dictionary lacks is an error.

    A dictionary of more than `most` terms is joined by a shuffle, but never by predicates or graphs, of which a few may
    have nearly all rows: their terms are gathered first, unless given as `few`, and broadcast if they are that few. They
    come before the others, so that these are shuffled with codes in place of terms."""
    most = MOST_BROADCAST_TERMS if most is None else most
    columns = [*quads.columns]
    if count > most:
        rows = quads.count() if rows is None else rows
        hot = (hot or {}) | hot_values(quads, [c for c in QUAD if c not in (hot or {}) and (c in "so" or not few)], rows)  # before any join, which would be made once more
        if hot["s"] and "_tie" not in columns:
            quads = tied(quads)
    code = lambda c, x: F.coalesce(x, F.raise_error(F.concat(F.lit("not in the dictionary: "), F.lit(c))).cast("long"))
    for c in ("p", "g", "o", "s"):
        part, n = terms, count
        if count > most and c in "pg":
            part = few[c] if few else written(of_position(quads, terms, "term", c), fresh(quads.sparkSession, f"terms_{c}"))
            n = part.count()
        if n <= most:
            side = _side(part.select(F.col("term").alias("_t"), F.col("code").alias("_c")), n, most)
            quads = quads.join(side, F.col(c) == F.col("_t"), "left").withColumn(c, code(c, F.col("_c"))).drop("_t", "_c")
        else:  # no term begins with a line end
            spread = F.concat(F.lit("\n"), F.col("_tie" if hot["s"] else "s").cast("string"))
            quads = _joined(quads, c, part, "term", "code", rows, n, hot[c] if c in hot else [], spread).withColumn(c, code(c, F.col("_v"))).drop("_v")
    return quads.select(*columns)


def decoded(codes: DataFrame, terms: dict[str, tuple[DataFrame, int]], most: int | None = None, rows: int | None = None) -> DataFrame:
    """Codes of some positions by their terms; terms has a dictionary, and how many terms it has, for each of them."""
    names, most = codes.columns, MOST_BROADCAST_TERMS if most is None else most
    order = sorted([*terms][::-1], key=lambda c: terms[c][1] <= most)  # the shuffled ones first, while rows are short
    if any(n > most for _, n in terms.values()):
        rows = codes.count() if rows is None else rows
        hot = hot_values(codes, [c for c in order if terms[c][1] > most], rows)
        if any(hot.values()):
            codes = tied(codes)
    for c in order:
        part, n = terms[c]
        if n <= most:
            side = _side(part.select(F.col("code").alias("_c"), F.col("term").alias("_t")), n, most)
            codes = codes.join(side, F.col(c) == F.col("_c")).drop(c, "_c").withColumnRenamed("_t", c)
        else:  # no code is negative
            codes = _joined(codes, c, part, "code", "term", rows, n, hot[c], (-1 - F.col("_tie")).cast("long") if hot[c] else None).where(F.col("_v").isNotNull()).drop(c).withColumnRenamed("_v", c)
    return codes.select(*names)
