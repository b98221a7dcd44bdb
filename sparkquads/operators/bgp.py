"""Joins of several triple patterns over shared variables. An extension: stores themselves answer single patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern


def basic_graph_pattern(match, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """One column for each variable (?name) of the patterns, bag semantics. match(pattern) gives the quads of a pattern.
    Patterns are joined in the order given as far as they share a variable with those before; Catalyst reorders further."""
    sides = []
    for spo in patterns:
        fixed = Pattern.of(*(None if x.startswith("?") else x for x in spo))
        df = match(fixed)
        names: dict[str, str] = {}
        for c, x in zip("spo", spo):
            if x.startswith("?"):
                if x[1:] in names:
                    df = df.where(F.col(c) == F.col(names[x[1:]]))
                else:
                    names[x[1:]] = c
        sides.append(df.select(*(F.col(c).alias(v) for v, c in names.items())))
    out, rest = sides[0], sides[1:]
    while rest:
        i = next((i for i, r in enumerate(rest) if set(r.columns) & set(out.columns)), 0)
        side = rest.pop(i)
        shared = [c for c in side.columns if c in out.columns]
        out = out.join(side, shared) if shared else out.crossJoin(side)
    return out
