"""RDF quads on Spark DataFrames."""

from .plans.pattern import DEFAULT_GRAPH, Pattern
from .store import QuadStore, StoreError

__all__ = ["DEFAULT_GRAPH", "Pattern", "QuadStore", "StoreError"]
