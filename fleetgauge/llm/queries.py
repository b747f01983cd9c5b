"""Registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.llm import (
    backoff, centroids, line_dedup, mixing, oracle, personal, pieces, quality_rules, repeats, secret_scan, simhash, spelling, toxicity, vectors,
)
from fleetgauge.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "lower(lpad(hex(fp), 16, '0')) AS fingerprint", "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "source")).selectExpr(
        "doc_id", "_block AS block", "_offset AS place", "_slot AS slot", "_release AS release", "_deadline AS deadline")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).selectExpr(
        "doc_id", "cast(_lines AS bigint) AS n_lines", "cast(_removed AS bigint) AS n_removed", "sha2(text, 256) AS kept_sha256")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [f"cast(size(regexp_extract_all(base, '(^|,){k}:', 0)) AS bigint) AS n_{k}" for k in secret_scan.KINDS]
    return secret_scan.scan(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", *kinds, "sha2(base, 256) AS base_sha256", "found AS spans")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [f"cast(size(regexp_extract_all(base, '(^|,){k}:', 0)) AS bigint) AS n_{k}" for k in personal.BASE]
    return personal.find(spark, table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", *kinds, "sha2(base, 256) AS base_sha256", "found AS spans")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_embeddings": op9_embeddings,
    "op10_lm_scores": op10_lm_scores,
    "op11_personal_data": op11_personal_data,
    "op12_centroids": op12_centroids,
    "op13_spelling": op13_spelling,
}
ORACLE: dict[str, str] = {
    "op4_mixing": oracle.mixing(),
    "op5_quality_rules": oracle.quality_rules(),
    "op12_centroids": oracle.clusters(),
    "op13_spelling": oracle.spelling(),
}
