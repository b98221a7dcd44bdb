"""Command line: serialize RDF text to a store, deserialize a store to RDF text, match a pattern."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.pattern import DEFAULT_GRAPH
from .schema import BUILDERS, INDEXES, LAYOUTS
from .sources import rdf_text
from .sources.formats import detect_format
from .store import QuadStore


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkquads")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("serialize", help="RDF text to a store")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--format")
    c.add_argument("--layout", default="default", choices=LAYOUTS)
    c.add_argument("--index", action="append", default=[], choices=INDEXES)
    c.add_argument("--builder", default="sorted_stream", choices=BUILDERS)
    for name in ("deserialize", "match"):
        c = sub.add_parser(name)
        c.add_argument("input", help="a store" + " or RDF text" * (name == "match"))
        c.add_argument("--format", default=None, help="of the output; nq unless given")
        c.add_argument("--output", help="a folder; standard output unless given")
        if name == "match":
            c.add_argument("--input-format")
            for x in ("subject", "predicate", "object", "graph"):
                c.add_argument(f"--{x}")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparkquads").getOrCreate()
    try:
        if a.command == "serialize":
            if not (a.format or detect_format(a.input)):
                raise ValueError(f"no format is known for {a.input}")
            store = QuadStore.build(rdf_text.read(spark, a.input, a.format), a.output, a.layout, a.index, a.builder)
            print(f"{store.size()} quads", file=sys.stderr)
            return 0
        text = a.command == "match" and (a.input_format or detect_format(a.input))
        store = QuadStore.build(rdf_text.read(spark, a.input, a.input_format), builder="unsorted_stream") if text else QuadStore.open(spark, a.input)
        if a.command == "match":
            g = DEFAULT_GRAPH if a.graph in ("", "default", "[]") else a.graph
            store = store.match(a.subject, a.predicate, a.object, g)
        if a.output:
            rdf_text.write(store.quads(), a.output, a.format)
        else:
            for text in rdf_text.lines(store.quads(), a.format or "nq"):
                print(text)
        return 0
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
