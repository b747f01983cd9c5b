"""Counters over stored runs, reports, calls and ingested logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.operators.metrics import Analysis, is_available


def ingestion_summary(analysis: Analysis) -> DataFrame:
    """Per log: completed or blocked, and how much was found."""
    found = analysis.events.groupBy("file_id").agg(F.count(F.lit(1)).alias("events"))
    measured = analysis.metrics.groupBy("file_id").agg(
        F.count_if(is_available()).alias("metrics_available"),
        F.count_if(~is_available()).alias("metrics_missing"))
    return (
        analysis.quality.select("file_id", F.col("verdict").alias("quality_verdict"))
        .join(found, "file_id", "left")
        .join(measured, "file_id", "left")
        .join(analysis.scope.select("file_id", F.col("window_id").alias("primary_window_id")), "file_id", "left")
        .select(
            "file_id",
            F.when(F.col("quality_verdict") == "blocked", "blocked").otherwise("completed").alias("status"),
            "quality_verdict",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "metrics_available", "metrics_missing")],
            "primary_window_id",
        )
    )


def dashboard_summary(projects: DataFrame, files: DataFrame, runs: DataFrame, reports: DataFrame,
                      approvals: DataFrame) -> DataFrame:
    """Long form ``measure, value`` so every table contributes its own aggregation."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("measure"), "value")

    totals = runs.agg(
        F.count(F.lit(1)).cast("double").alias("agent_runs"),
        F.avg("evidence_support_rate").alias("avg_evidence_support_rate"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("double").alias("llm_prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("double").alias("llm_completion_tokens"),
    )
    names = ["agent_runs", "avg_evidence_support_rate", "llm_prompt_tokens", "llm_completion_tokens"]
    by_label = reports.groupBy("report_confidence").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.concat(F.lit("reports_by_confidence:"), F.col("report_confidence")).alias("measure"), "value")
    return (
        counted(projects, "projects")
        .unionByName(counted(files, "files"))
        .unionByName(counted(reports, "reports"))
        .unionByName(counted(approvals.filter("status = 'pending_review'"), "approvals_pending"))
        .unionByName(totals.unpivot([], names, "measure", "value"))
        .unionByName(by_label)
    )


def call_usage(calls: DataFrame) -> DataFrame:
    """Tokens, latency and failures of the call log, by provider, model and kind of call."""
    return calls.groupBy("provider", "model", "kind").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("latency_s").alias("total_latency_s"), F.count_if(~F.col("ok")).alias("failures"))
