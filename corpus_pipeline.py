"""A corpus from raw documents to shards. Each stage works on all that the one before it kept.

Every stage takes a table with the columns of documents and, but for the last, returns these COLUMNS in that order;
further columns, whatever their names, are dropped. Repeated rows are rows each. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkquads.llm import decontaminate, hashtree, langid, mixing, setsketch
from sparkquads.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language is rejected.

    Rejected are null and empty texts, ties and texts whose margin is narrow, and all if no document has a language.
    A null lang is not used for fitting but its text is judged; null ids, sources and sizes don't matter. Long texts
    count whole, in pieces. Repeated rows stay or go together."""
    return langid.accepted(docs.select(*COLUMNS)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    A null id is the least; ties of ids go by the text's hash; of repeated rows one stays. Texts that are null or
    without words are in no group and all stay. Long texts are compared whole."""
    return setsketch.deduplicated(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of a benchmark item: 13 words of it, or all of a shorter one of 5 words
    or more (decontaminate.LEAST).

    Null and empty texts hold none and stay; null, empty and repeated items add nothing; an empty benchmark takes
    nothing away. Long texts are searched whole. Repeated rows stay or go together."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, in equal rows.

    The null source is a source. A null n_chars counts as the text's length, and as 0 if that is null too; a source
    without characters has no copies. Ties of ids go by the text's hash; repeated rows are drawn each for itself."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the region, rack and shard of each document, by its id alone.

    A null id is placed like the text "null"; rows of one id go together; texts, null or long, aren't looked at."""
    return hashtree.sharded(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("sharding", sharding),
]

#: Compression and register values can't be had in SQL; tests/llm/test_pipeline_rows.py compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
