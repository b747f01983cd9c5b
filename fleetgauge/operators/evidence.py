"""Citable evidence items per log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.kinematics import format_value
from fleetgauge.operators.metrics import Analysis, is_available

ITEM = ("file_id", "evidence_id", "kind", "summary", "t_s", "passed")
PYTHON_THRESHOLD = "CASE WHEN threshold_bool THEN 'True' WHEN NOT threshold_bool THEN 'False' ELSE string(threshold) END"


def _items(df: DataFrame, kind: str, evidence_id: str, summary: str, t_s: str = "CAST(NULL AS DOUBLE)",
           passed: str = "CAST(NULL AS BOOLEAN)") -> DataFrame:
    return df.selectExpr(
        "file_id", f"{evidence_id} AS evidence_id", f"'{kind}' AS kind", f"{summary} AS summary",
        f"{t_s} AS t_s", f"{passed} AS passed")


def evidence_items(analysis: Analysis, retrieved: DataFrame | None = None) -> DataFrame:
    """File, quality, events, windows and available metrics of every analysable log.

    ``retrieved`` adds chunks: file_id, chunk_id, source_type, version, document_title, heading,
    requirement_ids, stale.
    """
    files = analysis.profile.select("file_id", "rows", "extent_s", "t_samples").join(
        analysis.provenance.select("file_id", "source_path", "conversions"), "file_id")
    conversions = ("coalesce(nullif(array_join(transform(conversions, c -> concat(c.source_column, '->', "
                   "c.target_column)), ', '), ''), 'none')")
    windows = analysis.windows.join(
        analysis.scope.select("file_id", F.col("window_id").alias("primary_id")), "file_id")
    parts = [
        _items(files, "file", "file_id",
               "concat(source_path, '; ', rows, ' rows; duration ', "
               f"IF(t_samples >= 2, string(extent_s), 'None'), 's; conversions: ', {conversions})"),
        _items(analysis.quality.filter("verdict <> 'blocked'"), "quality", "quality_id",
               "concat('verdict ', verdict, ': ', gate_summary)", passed="true"),
        _items(analysis.events, "event", "event_id", "concat(event_type, ': ', description)", "t_s"),
        _items(windows, "window", "window_id",
               "concat(format_string('%.2f', start_s), 's..', format_string('%.2f', end_s), 's around event ', "
               "event_id, ' (', sample_count, ' samples)', IF(clipped_start OR clipped_end, ' (clipped to log)', ''), "
               "IF(window_id = primary_id, ' PRIMARY', ''))", "t_event_s"),
        _items(analysis.metrics.filter(is_available()), "metric", "metric_id",
               f"concat(name, ' = ', {format_value('value', 'value_bool')}, ' ', unit, IF(comparator IS NOT NULL, "
               f"concat(' (threshold ', comparator, ' ', {PYTHON_THRESHOLD}, ')'), ''), '; method: ', method)",
               "t_s", "passed"),
    ]
    if retrieved is not None:
        parts.append(_items(
            retrieved, "chunk", "chunk_id",
            "concat(source_type, ' v', coalesce(version, '?'), ': ', document_title, ' > ', heading, ' [ids: ', "
            "coalesce(nullif(array_join(requirement_ids, ', '), ''), '-'), ']', IF(stale, ' STALE', ''))"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing_items(metrics: DataFrame) -> DataFrame:
    """Metrics that could not be computed, as ``name: reason``."""
    return metrics.filter(~is_available()).selectExpr(
        "file_id", "metric_index AS pos", "concat(name, ': ', missing_reason) AS item")
