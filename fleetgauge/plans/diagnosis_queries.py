"""The chain from metrics to verified citations, per log."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.operators import diagnosis as dg
from fleetgauge.operators import verification as vf
from fleetgauge.plans import fixtures as fx
from fleetgauge.plans import report_views  # noqa: F401  (adds the views)
from fleetgauge.plans.document_queries import READER, TODAY
from fleetgauge.plans.registry import register
from fleetgauge.plans.telemetry_queries import stored_analysis
from fleetgauge.plans.views import VIEWS
from fleetgauge.session import shared_folder, stored

VIEWS["v_log_query"] = f"""
SELECT file_id, concat_ws(' ', '{v.BASE_QUERY}', string_agg(name, ' ' ORDER BY metric_index) FILTER (WHERE passed = false),
  '{v.LOGGING_QUERY} ' || string_agg(name, ' ' ORDER BY metric_index) FILTER (WHERE value IS NULL AND value_bool IS NULL)) AS query
FROM v_metrics GROUP BY file_id"""

# the views of retrieval once more, for the queries of the logs
_SAME = ("v_qterms", "v_bm25", "v_qvec", "v_qnorm", "v_cos", "v_pairs", "v_hybrid", "v_ranked")
VIEWS["v_lg_queries"] = "SELECT DISTINCT query AS query_id, query FROM v_log_query"
for _name in _SAME:
    VIEWS[_name.replace("v_", "v_lg_")] = re.sub(
        r"\bv_(queries|" + "|".join(n[2:] for n in _SAME) + r")\b", r"v_lg_\1", VIEWS[_name]).replace("rank <= 5", f"rank <= {dg.TOP_K}")

VIEWS["v_log_chunks"] = r"""
SELECT l.file_id, r.rank, c.chunk_id, c.source_type, c.text, r.stale, c.source_type || ' v?: ' || c.document_title || ' > ' || c.heading || ' [ids: '
  || coalesce(nullif(array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ', '), ''), '-') || ']' || CASE WHEN r.stale THEN ' STALE' ELSE '' END AS summary
FROM v_log_query l JOIN v_lg_ranked r ON r.query_id = l.query
JOIN (SELECT *, regexp_extract_all(heading || ' ' || piece, '\b(?:REQ|TC|SCN)-[A-Z]+(?:-[A-Z]+)*-\d+\b|\bINC-\d+\b') AS ids FROM v_chunks) c ON c.chunk_id = r.chunk_id"""
VIEWS["v_log_evidence"] = """
SELECT file_id, evidence_id, kind, CASE WHEN kind IN ('metric', 'event', 'window') THEN 'telemetry' ELSE kind END AS source, summary, t_s, passed,
  false AS stale, false AS injection_flagged FROM v_items
UNION ALL SELECT file_id, chunk_id, 'chunk', 'doc:' || source_type, summary, NULL, NULL, stale, contains(text, 'Ignore previous instructions') FROM v_log_chunks"""

# every log cites what it was offered and what the log after it was offered
VIEWS["v_log_cites"] = """
SELECT DISTINCT file_id, evidence_id FROM (
  SELECT file_id, evidence_id FROM v_log_evidence
  UNION ALL SELECT f.file_id, e.evidence_id FROM (SELECT file_id, lead(file_id) OVER (ORDER BY file_id) AS after FROM (SELECT DISTINCT file_id FROM v_log_evidence) y) f
    JOIN v_log_evidence e ON e.file_id = f.after) x"""


def _diagnosis(spark, sf_dir):
    indexed, postings = fx.index(spark, sf_dir)
    return dg.diagnosis(stored_analysis(spark, sf_dir), indexed, postings, today=TODAY, filters=READER)


@register("diagnosis_evidence", "SELECT file_id, evidence_id, kind, source, summary, t_s, passed, stale, injection_flagged FROM v_log_evidence")
def diagnosis_evidence(spark, sf_dir):
    """Registry of every log, written and read again."""
    path = f"{shared_folder(spark)}/fleetgauge-registry-{uuid.uuid4().hex}"
    dg.publish_registry(_diagnosis(spark, sf_dir).registry, path)
    return spark.read.parquet(path)


@register("diagnosis_chunks", "SELECT file_id, rank, chunk_id, stale FROM v_log_chunks")
def diagnosis_chunks(spark, sf_dir):
    return _diagnosis(spark, sf_dir).retrieved.select("file_id", "rank", "chunk_id", "stale")


def _scoped(spark, sf_dir):
    registry = stored(_diagnosis(spark, sf_dir).registry, "registry")
    logs = registry.select("file_id").distinct().withColumn("number", F.expr("CAST(right(file_id, 12) AS BIGINT)"))
    follows = _next_log(logs)
    other = follows.join(registry.select(F.col("file_id").alias("after"), "evidence_id"), "after").select("file_id", "evidence_id")
    cites = stored(registry.select("file_id", "evidence_id").unionByName(other).distinct().selectExpr(
        "file_id AS hyp_key", "file_id", "evidence_id", "0 AS pos"), "cites")
    return cites, registry


def _next_log(logs):
    from fleetgauge.operators.segments import ranked

    numbered = stored(ranked(logs.withColumn("_all", F.lit(0)), ["_all"], [F.col("number")], F.expr("number DIV 4096"), "place"), "log-places")
    return numbered.select("file_id", "place").join(
        numbered.select(F.col("file_id").alias("after"), (F.col("place") - 1).alias("place")), "place").drop("place")


@register("diagnosis_citations", """
SELECT c.file_id, c.evidence_id, e.evidence_id IS NOT NULL AS resolved, e.source FROM v_log_cites c
LEFT JOIN v_log_evidence e ON e.file_id = c.file_id AND e.evidence_id = c.evidence_id""")
def diagnosis_citations(spark, sf_dir):
    """Ids of the own log resolve, ids that only another log was offered don't."""
    cites, registry = _scoped(spark, sf_dir)
    return vf.resolve_citations(cites, registry, dg.SCOPE).select("file_id", "evidence_id", "resolved", "source")


@register("diagnosis_untraceable", """
SELECT c.file_id AS key, c.evidence_id FROM v_log_cites c LEFT JOIN v_log_evidence e ON e.file_id = c.file_id AND e.evidence_id = c.evidence_id
WHERE e.evidence_id IS NULL AND NOT starts_with(c.evidence_id, 'file_')""")
def diagnosis_untraceable(spark, sf_dir):
    """Texts that name ids of their own log and of another: the others refuse the report, but for logs' names, which are the report's own."""
    cites, registry = _scoped(spark, sf_dir)
    texts = cites.selectExpr("file_id AS key", "file_id", "concat('see ', evidence_id, '.') AS text")
    own = cites.where("startswith(evidence_id, 'file_')").selectExpr("file_id AS key", "evidence_id")
    return vf.assert_traceable(texts, registry, own, dg.SCOPE).select("key", "evidence_id")
