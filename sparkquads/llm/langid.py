"""Language identification by compression.

For each language a Zstandard raw-content dictionary is filled with labelled texts. A text, in lower case, is compressed
with every dictionary, in pieces of PIECE bytes so that a long text doesn't become its own dictionary, and the language
with the smallest total wins. If the runner-up is hardly larger, the text is rejected.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_buffer

#: Bound of what is fitted: labelled documents per language, those of the least hashes, and bytes of dictionary. Of a
#: document with more than its share of the bytes, pieces of SEGMENT bytes go in, evenly spaced from its begin to its end.
SAMPLE_DOCS, DICTIONARY_BYTES, SEGMENT = 400, 64 << 10, 64
#: Levels below 5 look up one place only for each hash, which makes sizes much less telling.
PIECE, LEVEL = 8192, 5
#: Least share of its size by which the runner-up must exceed the smallest.
MARGIN = 0.005


def dictionaries(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Of each language in the column lang, pieces of up to sample_docs different documents, of each an equal share of
    the bytes at least. Null and empty languages and texts teach nothing; rows equal in id and text count once, so at
    most sample_docs texts of a language reach the driver."""
    known = docs.where((F.length(F.col("lang").cast("string")) > 0) & (F.length(F.col("text").cast("string")) > 0))
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    known = known.select("lang", F.xxhash64("id", "text").alias("h"), "text")
    ranked = known.select("lang", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    last = {r.lang: r.last for r in ranked.where(F.col("n") <= sample_docs).groupBy("lang").agg(F.max("h").alias("last")).toLocalIterator()}
    if not last:
        return {}
    sampled = reduce(Column.__or__, [(F.col("lang") == lang) & (F.col("h") <= h) for lang, h in last.items()])
    texts: dict[str, list[str]] = {lang: [] for lang in sorted(last)}
    for r in known.where(sampled).groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").toLocalIterator():
        texts[r.lang].append(r.text)
    return {lang: _filled([t.lower().encode() for t in rows], size) for lang, rows in texts.items()}


def _spread(text: bytes, room: int) -> bytes:
    """The text or, if it is longer than the room, pieces from all over it, none of which cuts a character."""
    if len(text) <= room:
        return text
    n = max(1, room // SEGMENT)
    size, out = room // n, []
    for i in range(n):
        a = len(text) * i // n
        b = a + size
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[a:b])
    return b"\n".join(out)


def _filled(texts: list[bytes], size: int) -> bytes:
    """Joins the texts by length, of long ones so much that all together fit, but for line ends."""
    room, out = size, []
    for i, t in enumerate(sorted(texts, key=lambda t: (len(t), t))):
        share = room // (len(texts) - i)
        out.append(_spread(t, share))
        room -= min(len(t), share)
    return b"\n".join(out)


@lru_cache(maxsize=4)
def _compressors(dicts: tuple[tuple[str, bytes], ...], level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, d in dicts:
        z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        z.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=z, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def sizes(text: bytes | memoryview, dicts: dict[str, bytes], level: int = LEVEL) -> list[int]:
    """Compressed size with each dictionary. The whole text counts, in pieces of like length."""
    cs = _compressors(tuple(dicts.items()), level)
    pieces = max(1, -(-len(text) // PIECE))
    cuts = [len(text) * i // pieces for i in range(pieces + 1)]
    return [sum(len(c.compress(text[a:b])) for a, b in zip(cuts, cuts[1:])) for c in cs]


def identifier(docs: DataFrame, dicts: dict[str, bytes], level: int = LEVEL):
    """A function of a text column: struct(language, margin)."""
    # of bounded size: DICTIONARY_BYTES for each language
    shared = docs.sparkSession.sparkContext.broadcast(dicts)

    @F.arrow_udf("language string, margin double")
    def identify(texts: pa.Array) -> pa.Array:
        names = list(shared.value)
        language: list[str | None] = []
        margin: list[float] = []
        for part in slices(pa.RecordBatch.from_arrays([pc.utf8_lower(texts)], ["text"])):
            buf, off = text_buffer(part.column(0))
            data = memoryview(buf)
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                if a == b or not names:
                    language.append(None)
                    margin.append(0.0)
                    continue
                got = np.array(sizes(data[a:b], shared.value, level))
                order = np.argsort(got, kind="stable")
                language.append(names[order[0]])
                margin.append(float(got[order[1]] - got[order[0]]) / float(got[order[0]]) if len(got) > 1 else 1.0)
        return pa.StructArray.from_arrays([pa.array(language, pa.string()), pa.array(margin, pa.float64())], ["language", "margin"])

    def of(text: Column) -> Column:
        return identify(F.coalesce(text.cast("string"), F.lit("")))

    return of


def identified(docs: DataFrame, fit_on: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """docs with the columns language, the one found or null if rejected, and margin, which replace any of these names.

    Rejected are null and empty texts, texts whose margin is narrower than the bound, and all if nothing is labelled.
    With a single language in the labels the margin is 1. Repeated rows come back alike; ties go to the language first
    by name and are rejected as their margin is 0. The labels are fit_on's or docs' own column lang.
    """
    dicts = dictionaries(docs if fit_on is None else fit_on)
    rows = docs.drop(*[c for c in docs.columns if c.lower() in ("language", "margin")])
    rows = rows.select(F.struct("*").alias("row"), identifier(docs, dicts)(F.col("text")).alias("found"))
    good = F.col("found.margin") >= margin
    return rows.select("row.*", F.when(good, F.col("found.language")).alias("language"), F.round("found.margin", 6).alias("margin"))


def accepted(docs: DataFrame, fit_on: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """The rows of identified() whose language was found."""
    return identified(docs, fit_on, margin).where("language is not null")
