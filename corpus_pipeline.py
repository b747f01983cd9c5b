"""Corpus pipeline: documents to training ids in five stages, each one operator of ``fleetgauge.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of ``docs`` (the last
one: ids). ``run`` writes each stage to the shared folder and reads it again, so a lost executor costs one stage at most.

The mixing stage keeps every row and decides their order. Files are not read in the order they were written in, so the order
is a value: the ids come with the block's ``slot`` in the mix and the ``place`` in the block, which follow from the rows alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.llm import line_dedup, mixing, pieces, quality_rules, simhash
from fleetgauge.llm.common import table
from fleetgauge.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that repeat earlier ones, exactly or nearly."""
    return line_dedup.dedup(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, slot, place`` with the text as piece ids; ``restored`` tells that decoding gives the text back."""
    placed = mixing.schedule(docs.select("doc_id", "lang", "source", "text")).selectExpr(
        "doc_id", "lang", "source", "text", "_slot AS slot", "_offset AS place")
    return pieces.encode(placed, pieces.MODEL, "lang", "source", "slot", "place")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]

# MinHash buckets, components and piece merges are not expressed in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
