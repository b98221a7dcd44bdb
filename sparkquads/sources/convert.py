"""One-shot conversions between RDF text and a store's bytes, for what fits on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..store import QuadStore
from . import rdf_text


def text_to_store(spark: SparkSession, text: str | bytes, fmt: str, path: str | None = None, base: str = "", **kw) -> QuadStore:
    return QuadStore.build(rdf_text.from_string(spark, text.decode() if isinstance(text, bytes) else text, fmt, base), path, **kw)


def store_to_text(store: QuadStore, fmt: str = "nq") -> str:
    """One document, with a line end behind each of its lines."""
    return "".join(f"{line}\n" for line in rdf_text.lines(store.quads(), fmt))


def text_to_bytes(spark: SparkSession, text: str | bytes, fmt: str, **kw) -> bytes:
    return text_to_store(spark, text, fmt, **kw).to_bytes()


def bytes_to_text(spark: SparkSession, data: bytes, fmt: str = "nq") -> str:
    return store_to_text(QuadStore.from_bytes(spark, data), fmt)
