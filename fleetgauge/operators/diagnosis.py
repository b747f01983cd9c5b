"""From the metrics of each log to the evidence its diagnosis may cite.

metrics -> query text -> retrieval -> evidence items with chunks -> registry of the log -> verification. All steps are keyed by
log: an id resolves only in the registry of the log it was offered for, so what another log was offered is unknown here.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions import text as tx
from fleetgauge.operators import corpus, retrieval
from fleetgauge.operators import verification as vf
from fleetgauge.operators.evidence import evidence_items
from fleetgauge.operators.metrics import Analysis
from fleetgauge.policies import RetrievalFilters, RetrievalWeights
from fleetgauge.session import stored

TOP_K = 6
SCOPE = ("file_id",)


@dataclass
class Diagnosis:
    """``retrieved``: file_id, rank, chunk columns, stale. ``items``: evidence with chunks. ``flags``: file_id, evidence_id, pattern,
    excerpt. ``registry``: file_id, evidence_id, source and flags."""

    retrieved: DataFrame
    items: DataFrame
    flags: DataFrame
    registry: DataFrame


def retrieved_chunks(
    metrics: DataFrame, indexed: DataFrame, posting_table: DataFrame, *, today: dt.date, filters: RetrievalFilters,
    weights: RetrievalWeights = RetrievalWeights(), top_k: int = TOP_K,
) -> DataFrame:
    """The ``top_k`` chunks of each log's query. Logs that ask the same share one retrieval: the text is the query's key."""
    asked = stored(retrieval.retrieval_query_text(metrics), "log-queries")
    distinct = asked.select(F.col("query").alias("query_id"), "query").distinct()
    found = retrieval.hybrid_retrieve(indexed, posting_table, distinct, today=today, filters=filters, weights=weights, top_k=top_k)
    shown = indexed.select("chunk_id", "source_type", "version", "document_title", "heading", "requirement_ids", "text",
                           tx.is_stale(F.col("valid_from"), today, weights.stale_after_days).alias("stale"))
    best = stored(found.withColumnRenamed("query_id", "query").select("query", "rank", "chunk_id").join(shown, "chunk_id"), "found-chunks")
    return asked.join(best, "query").drop("query")


def diagnosis(
    analysis: Analysis, indexed: DataFrame, posting_table: DataFrame, *, today: dt.date, filters: RetrievalFilters, top_k: int = TOP_K,
) -> Diagnosis:
    """Evidence and registry of every analysable log."""
    retrieved = stored(retrieved_chunks(analysis.metrics, indexed, posting_table, today=today, filters=filters, top_k=top_k), "retrieved")
    items = stored(evidence_items(analysis, retrieved), "evidence")
    hits = corpus.injection_scan(retrieved.select("chunk_id", "text").dropDuplicates(["chunk_id"]))
    flags = retrieved.select("file_id", "chunk_id").join(hits, "chunk_id").withColumnRenamed("chunk_id", "evidence_id")
    sources = retrieved.select("file_id", F.col("chunk_id").alias("evidence_id"), "source_type", "stale")
    return Diagnosis(retrieved, items, flags, vf.evidence_registry(items, sources, flags, SCOPE))


def publish_registry(registry: DataFrame, path: str, scope: tuple[str, ...] = SCOPE) -> None:
    """Writes the registry if no id occurs twice in its scope; otherwise nothing is written and the job stops."""
    checked = stored(registry, "registry")
    twice = vf.duplicate_ids(checked, scope).limit(5).collect()
    if twice:
        raise ValueError("duplicate evidence ids: " + ", ".join("/".join(str(r[c]) for c in (*scope, "evidence_id")) for r in twice))
    checked.write.mode("overwrite").parquet(path)
