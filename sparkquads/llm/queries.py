"""One query for each operator, over the whole of its table, and its SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hashtree, hostrules, langid, lines, mixing, phrases, repeats, setsketch, suffixes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.repeated_spans(table(spark, sf_dir, "documents"))


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashtree.sharded(table(spark, sf_dir, "documents")).select("doc_id", *hashtree.LEVELS)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.accepted(table(spark, sf_dir, "documents")).select("doc_id", "language", "margin")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what the draws need; texts would only travel along
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("n_chars", F.length("text")).alias("n_chars"))
    return mixing.mixed(docs).select("doc_id", "source", "copy")


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.kept(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_repeated_phrases,
        op3_line_windows,
        op4_warc,
        op5_hash_tree,
        op6_language,
        op7_suffix_array,
        op8_near_duplicates,
        op9_mixing,
        op10_host_rules,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_repeated_phrases": repeats.ORACLE,
    "op3_line_windows": lines.ORACLE,
    "op5_hash_tree": hashtree.oracle(),
    "op7_suffix_array": repeats.ORACLE,
    "op9_mixing": mixing.oracle(),
    "op10_host_rules": hostrules.ORACLE,
}
