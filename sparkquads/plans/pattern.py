"""Quad patterns and where they are answered from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import terms
from ..schema import IRI, QUAD


class _DefaultGraph:
    """The default graph as a bound position; None leaves the graph open."""

    def __repr__(self) -> str:
        return "DEFAULT_GRAPH"


DEFAULT_GRAPH = _DefaultGraph()


@dataclass(frozen=True)
class Pattern:
    """Terms in canonical form, None where open."""

    s: str | None = None
    p: str | None = None
    o: str | None = None
    g: str | None = None

    @classmethod
    def of(cls, s=None, p=None, o=None, g=None) -> Pattern:
        """Checks the terms, which may be of other libraries (terms.coerced), and raises ValueError for those that can't be
        in their position."""
        s, p, o, g = (x if x is DEFAULT_GRAPH else terms.coerced(x) for x in (s, p, o, g))
        for name, x in zip(QUAD, (s, p, o, g)):
            if x is not None and not isinstance(x, str) and x is not DEFAULT_GRAPH:
                raise ValueError(f"{name} must be a string or None, not {type(x).__name__}")
        return cls(
            None if s is None else terms.subject(s),
            None if p is None else terms.predicate(p),
            None if o is None else terms.term(o),
            None if g is None else "" if g is DEFAULT_GRAPH else terms.graph(g),
        )

    @property
    def bound(self) -> dict[str, str]:
        return {c: x for c in QUAD if (x := getattr(self, c)) is not None}

    def condition(self) -> Column:
        """Over columns s, p, o, g of terms."""
        return conjunction([F.col(c) == F.lit(x) for c, x in self.bound.items()])

    def typed_condition(self) -> Column:
        """Over the columns of the layout with a typed object; null columns are never compared."""
        out = [F.col(c) == F.lit(x) for c, x in self.bound.items() if c != "o"]
        if self.o is not None:
            if self.o.startswith('"'):
                value, lang, datatype = terms.literal_parts(self.o)
                parts = {"o_kind": 3 if lang else 4 if datatype else 2, "o_value": value, "o_lang": lang, "o_datatype": datatype}
            else:
                parts = {"o_kind": int(self.o.startswith("_:")), "o_value": self.o[2:]} if not self.o.startswith("<") else {"o_kind": IRI, "o_value": self.o[1:-1]}
            out += [F.col(c) == F.lit(x) for c, x in parts.items() if x is not None]
        return conjunction(out)


def conjunction(parts: list[Column]) -> Column:
    return reduce(Column.__and__, parts, F.lit(True))


def access_path(pattern: Pattern, indexes: tuple[str, ...]) -> str:
    """base, posg, ospg, ref_o or ref_p. With the subject bound the base is best, as it is sorted by it; a full copy
    goes before row ids, an object before a predicate. Row ids are used while they are few, see QuadStore._base."""
    b = pattern.bound
    if "s" not in b:
        if "by_copy" in indexes and ("p" in b or "o" in b):
            return "posg" if "p" in b else "ospg"
        if "by_reference" in indexes and ("o" in b or "p" in b):
            return "ref_o" if "o" in b else "ref_p"
    return "base"


#: Rows of tail from which a store is compacted: so many, or a share of the base and this least number.
MOST_TAIL, LEAST_TAIL, SHARE = 100_000, 4_096, 10


def tail_needs_compaction(tail: int, base: int) -> bool:
    return tail >= MOST_TAIL or tail >= max(LEAST_TAIL, base // SHARE)
