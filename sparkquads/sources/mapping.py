"""The direct mapping of the relational tables to quads, as DataFrames and as SQL for DuckDB, from one description.

A quad is a select of its own, so that a bound predicate, subject or graph prunes the other selects and their scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import escaped
from ..schema import RDF, XSD

X = "http://ex.org/"
TYPE = f"<{RDF}type>"
#: table: (prefix and key of the subject, graph, [(predicate, kind of object, column or name, what else)])
TABLES = {
    "region": (("<" + X + "region/", "r_regionkey", ">"), ("", None, ""), [(None, "class", "Region", ""), ("region#name", "text", "r_name", "")]),
    "nation": (("<" + X + "nation/", "n_nationkey", ">"), ("", None, ""), [(None, "class", "Nation", ""), ("nation#name", "text", "n_name", ""), ("nation#region", "ref", "n_regionkey", "region/")]),
    "customer": (
        ("<" + X + "customer/", "c_custkey", ">"),
        (f"<{X}graph/customer>", None, ""),
        [
            (None, "class", "Customer", ""),
            ("customer#name", "text", "c_name", ""),
            ("customer#nation", "ref", "c_nationkey", "nation/"),
            ("customer#acctbal", "decimal", "c_acctbal", ""),
            ("customer#segment", "lang", "c_mktsegment", "en"),
        ],
    ),
    "orders": (
        ("<" + X + "order/", "o_orderkey", ">"),
        (f"<{X}graph/orders/", "o_orderstatus", ">"),
        [
            (None, "class", "Order", ""),
            ("order#customer", "ref", "o_custkey", "customer/"),
            ("order#total", "decimal", "o_totalprice", ""),
            ("order#date", "time", "o_orderdate", ""),
            ("order#priority", "text", "o_orderpriority", ""),
        ],
    ),
    "events": (
        ("_:e", "event_id", ""),
        (f"<{X}graph/events>", None, ""),
        [(None, "ref", "event_type", "event/"), ("event#user", "integer", "user_id", ""), ("event#props", "text", "props", ""), ("event#ts", "time", "ts", "")],
    ),
}
TIME = "yyyy-MM-dd'T'HH:mm:ss"


def _object(kind: str, column: str, more: str) -> Column:
    if kind == "class":
        return F.lit(f"<{X}{column}>")
    c = F.col(column)
    lit, typed = F.lit, lambda v, t: F.concat(F.lit('"'), v, F.lit(f'"^^<{XSD}{t}>'))
    return {
        "ref": lambda: F.concat(lit(f"<{X}{more}"), c.cast("string"), lit(">")),
        "text": lambda: F.concat(lit('"'), escaped(c), lit('"')),
        "lang": lambda: F.concat(lit('"'), escaped(c), lit(f'"@{more}')),
        "decimal": lambda: typed(c.cast("decimal(18,2)").cast("string"), "decimal"),
        "integer": lambda: typed(c.cast("string"), "integer"),
        "time": lambda: typed(F.date_format(c, TIME), "dateTime"),
    }[kind]()


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quads of the tables; a null column makes none."""
    out = []
    for table, ((head, key, end), (graph, by, close), rows) in TABLES.items():
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        s = F.concat(F.lit(head), F.col(key).cast("string"), F.lit(end))
        g = F.concat(F.lit(graph), F.col(by), F.lit(close)) if by else F.lit(graph)
        for name, kind, column, more in rows:
            needed = {key, *([by] if by else []), *([] if kind == "class" else [column])}
            kept = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in sorted(needed)]))
            out.append(kept.select(s.alias("s"), F.lit(f"<{X}{name}>" if name else TYPE).alias("p"), _object(kind, column, more).alias("o"), g.alias("g")))
    return reduce(DataFrame.unionByName, out)


def _sql_object(kind: str, c: str, more: str) -> str:
    text = f"replace(replace(replace(replace({c}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"
    return {
        "class": f"'<{X}{c}>'",
        "ref": f"'<{X}{more}' || {c} || '>'",
        "text": f"'\"' || {text} || '\"'",
        "lang": f"'\"' || {text} || '\"@{more}'",
        "decimal": f"'\"' || cast({c} as decimal(18,2)) || '\"^^<{XSD}decimal>'",
        "integer": f"'\"' || {c} || '\"^^<{XSD}integer>'",
        "time": f"'\"' || strftime({c}, '%Y-%m-%dT%H:%M:%S') || '\"^^<{XSD}dateTime>'",
    }[kind]


def sql() -> str:
    """The same as a query; || is null where an operand is."""
    out = []
    for table, ((head, key, end), (graph, by, close), rows) in TABLES.items():
        g = f"'{graph}' || {by} || '{close}'" if by else f"'{graph}'"
        for name, kind, column, more in rows:
            out.append(f"select '{head}' || {key} || '{end}' s, '{f'<{X}{name}>' if name else TYPE}' p, {_sql_object(kind, column, more)} o, {g} g from {table}")
    return "select * from (" + " union all ".join(out) + ") where s is not null and o is not null and g is not null"
