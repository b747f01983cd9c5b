"""Report tables per log, built from measured facts and, when given, verified runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions.ids import stable_id
from fleetgauge.functions.kinematics import format_value
from fleetgauge.functions.sqltext import text
from fleetgauge.operators.metrics import Analysis, is_available

OBSERVED = format_value("value", "value_bool")
THRESHOLD = ("CASE WHEN comparator IS NULL THEN '' ELSE concat(comparator, ' ', CASE WHEN threshold_bool THEN 'true' "
             "WHEN NOT threshold_bool THEN 'false' ELSE string(threshold) END) END")


def metrics_table(metrics: DataFrame) -> DataFrame:
    """One row per metric; an unavailable metric has no id and shows a dash."""
    return metrics.selectExpr(
        "file_id", "metric_index", "IF(value IS NULL AND value_bool IS NULL, NULL, metric_id) AS metric_id",
        "name", f"{OBSERVED} AS observed", "unit", f"{THRESHOLD} AS threshold", "passed", "t_s", "missing_reason")


def timeline(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Events and thresholded metrics that have a time; reading order ``(t_s, kind, evidence_id)``."""
    happened = events.selectExpr(
        "file_id", "t_s", "event_id AS evidence_id", "'event' AS kind",
        "concat(event_type, ': ', description) AS description")
    judged = metrics.filter(is_available() & F.col("t_s").isNotNull() & F.col("comparator").isNotNull())
    return happened.unionByName(judged.selectExpr(
        "file_id", "t_s", "metric_id AS evidence_id", "'metric' AS kind",
        f"concat(name, ' = ', {OBSERVED}, ' ', unit, ' (', IF(passed, 'PASS', 'FAIL'), ' ', {THRESHOLD}, ')') "
        "AS description"))


def evidence_appendix(
    timeline_rows: DataFrame, registry: DataFrame, cited: DataFrame | None = None
) -> DataFrame:
    """Every artifact the report names, once: ``file_id, evidence_id, kind, source, summary, t_s``.

    ``cited``: file_id, evidence_id, rank, pos of a verified run; these come before the timeline.
    An artifact the registry does not hold stops the job: the report would not be traceable.
    """
    named = timeline_rows.selectExpr(
        "file_id", "evidence_id", "named_struct('part', 1, 'a', t_s, 'b', kind, 'c', evidence_id) AS place")
    if cited is not None:
        named = named.unionByName(cited.selectExpr(
            "file_id", "evidence_id",
            "named_struct('part', 0, 'a', CAST(rank AS DOUBLE), 'b', lpad(CAST(pos AS STRING), 20, '0'), "
            "'c', evidence_id) AS place"))
    once = named.groupBy("file_id", "evidence_id").agg(F.min("place").alias("place"))
    known = registry.select("file_id", "evidence_id", "kind", "source", "summary", "t_s")
    return once.join(known, ["file_id", "evidence_id"], "left").selectExpr(
        "file_id", "evidence_id", "place",
        "IF(kind IS NULL, raise_error(concat('report references unknown evidence ', evidence_id)), kind) AS kind",
        "source", "summary", "t_s")


def _pivoted(metrics: DataFrame) -> DataFrame:
    """One row per log with a struct per summarised metric (null when unavailable)."""
    names = (v.M_CROSSING, v.M_BRAKE, v.M_LATENCY, v.M_COLLISION, v.M_COLLISION_TIME, v.M_MIN_TTC, v.M_DROPOUT)
    shown = (f"named_struct('text', {OBSERVED}, 'id', metric_id, 'passed', passed, 'flag', value_bool, "
             "'value', value, 'limit', string(threshold))")
    found = "(value IS NOT NULL OR value_bool IS NOT NULL)"
    return metrics.groupBy("file_id").agg(*[
        F.expr(f"max(CASE WHEN name = '{n}' AND {found} THEN {shown} END) AS m_{n}") for n in names])


def executive_summary(metrics: DataFrame, verification: DataFrame | None = None) -> DataFrame:
    """Templated sentences per log: ``file_id, lines ARRAY<STRING>``.

    ``verification``: file_id, verification_id, report_confidence, human_review_required, kept,
    top_cause, top_class, top_label, top_ids. Logs without a row get the metrics-only wording.
    """
    def m(name: str) -> str:
        return f"m_{name}"
    cross, brake, late = m(v.M_CROSSING), m(v.M_BRAKE), m(v.M_LATENCY)
    crash, when, ttc, drop = m(v.M_COLLISION), m(v.M_COLLISION_TIME), m(v.M_MIN_TTC), m(v.M_DROPOUT)
    lines = [
        f"CASE WHEN {cross} IS NOT NULL AND {brake} IS NOT NULL AND {late} IS NOT NULL THEN concat("
        f"'The AEB brake command at ', {brake}.text, ' s followed the TTC threshold crossing at ', {cross}.text, "
        f"' s by ', {late}.text, ' s against a limit of ', {late}.limit, ' s: ', IF({late}.passed, 'PASS', 'FAIL'), "
        f"' [', {cross}.id, ', ', {brake}.id, ', ', {late}.id, '].') "
        f"WHEN {cross} IS NOT NULL AND {brake} IS NULL THEN concat('TTC crossed the trigger threshold at ', "
        f"{cross}.text, ' s but no brake command was logged [', {cross}.id, '].') "
        "ELSE 'No TTC threshold crossing was detected in this log; no AEB episode to assess.' END",
        f"CASE WHEN {crash}.flag THEN concat('A collision was recorded', coalesce(concat(' at ', {when}.text, ' s'), ''), "
        f"' [', concat_ws(', ', {crash}.id, {when}.id), '].') "
        f"WHEN {crash} IS NOT NULL THEN concat('No collision was recorded [', {crash}.id, '].') END",
        f"CASE WHEN {ttc} IS NOT NULL THEN concat('Minimum TTC was ', {ttc}.text, ' s (', IF({ttc}.passed, 'PASS', "
        f"'FAIL'), ' against >= ', {ttc}.limit, ' s) [', {ttc}.id, '].') END",
        f"CASE WHEN {drop}.value > 0 THEN concat('Perception confidence was below the validity threshold for ', "
        f"{drop}.text, ' s of the risk phase [', {drop}.id, '].') END",
    ]
    rows = _pivoted(metrics)
    only = text("No AI diagnosis was run; this is a metrics-only report. Root-cause hypotheses are not available.")
    if verification is None:
        closing = [only]
    else:
        rows = rows.join(verification, "file_id", "left")
        closing = [
            f"CASE WHEN verification_id IS NULL THEN {only} WHEN kept = 0 THEN concat('The AI diagnosis produced no "
            "hypothesis that survived evidence verification; report confidence is ', upper(report_confidence), '.') "
            "ELSE concat('Top verified hypothesis (', top_class, ', ', top_label, '): ', top_cause, ' [', "
            "array_join(top_ids, ', '), '].') END",
            "CASE WHEN kept > 0 THEN concat('Report confidence: ', upper(report_confidence), '; human review ', "
            "IF(human_review_required, 'required', 'not triggered'), ' [', verification_id, '].') END",
        ]
    return rows.selectExpr("file_id", f"array_compact(array({', '.join(lines + closing)})) AS lines")


def report_rows(analysis: Analysis, verification: DataFrame | None = None) -> DataFrame:
    """Report header per analysable log: confidence, event metadata and limitations.

    ``verification``: file_id, run_id, verification_id, report_confidence, human_review_required,
    limitations. Without a run the confidence is low.
    """
    clipped = analysis.windows.join(
        analysis.scope.select("file_id", "window_id"), ["file_id", "window_id"], "left_semi"
    ).filter("clipped_start OR clipped_end").selectExpr("file_id", "window_id AS clipped_id")
    base = (
        analysis.profile.select("file_id", "rows", "extent_s", "t_samples", "nominal_dt_s")
        .join(analysis.quality.select("file_id", "quality_id", "verdict", "warnings"), "file_id")
        .join(analysis.scope.select("file_id", "window_id"), "file_id")
        .join(analysis.provenance.select("file_id", "source_path", "scenario_id", "data_origin", "conversions"), "file_id")
        .join(clipped, "file_id", "left")
    )
    if verification is None:
        base = base.selectExpr(
            "*", "CAST(NULL AS STRING) AS run_id", "CAST(NULL AS STRING) AS verification_id",
            "'low' AS report_confidence", "false AS human_review_required",
            f"array_compact(array({text(v.NO_DIAGNOSIS_LIMITATION)}, IF(data_origin = 'synthetic', "
            f"{text(v.SYNTHETIC_LIMITATION)}, NULL))) AS limitations")
    else:
        base = base.join(verification, "file_id")
    more = ("IF(warnings <> '', concat('Data-quality warnings: ', warnings), NULL), "
            "IF(clipped_id IS NOT NULL, concat('The primary analysis window (', clipped_id, ') was clipped to the log "
            "bounds; context before or after the event is incomplete.'), NULL)")
    conversions = ("coalesce(nullif(array_join(transform(conversions, c -> concat(c.source_column, ' [', c.source_unit, "
                   "'] -> ', c.target_column, ' [', c.target_unit, ']')), ', '), ''), 'none')")
    return base.withColumn("report_id", stable_id("report", F.col("file_id"), F.col("quality_id"), F.col("run_id"))).selectExpr(
        "report_id", "file_id", "quality_id", "run_id", "verification_id", "report_confidence", "human_review_required",
        "source_path", "coalesce(scenario_id, 'n/a') AS scenario_id", "data_origin", "string(rows) AS rows",
        "IF(t_samples >= 2, string(extent_s), 'n/a') AS duration_s",
        "IF(nominal_dt_s > 0, format_string('%.1f', 1D / nominal_dt_s), 'n/a') AS sample_rate_hz",
        "concat(verdict, ' (', quality_id, ')') AS quality_verdict", "coalesce(window_id, 'none') AS primary_window",
        f"{conversions} AS unit_conversions",
        f"array_distinct(concat(limitations, array_compact(array({more})))) AS limitations")


def report_documents(header: DataFrame, summary: DataFrame, table: DataFrame, timeline_rows: DataFrame) -> DataFrame:
    """One JSON text per report. A log has at most thirteen metrics and three events, so the
    nested lists are short."""
    metric_list = table.groupBy("file_id").agg(F.expr(
        "array_sort(collect_list(struct(metric_index, metric_id, name, observed, unit, threshold, passed, t_s, "
        "missing_reason))) AS metrics_table"))
    lines = timeline_rows.groupBy("file_id").agg(F.expr(
        "array_sort(collect_list(struct(t_s, kind, evidence_id, description))) AS timeline"))
    whole = header.join(summary, "file_id", "left").join(metric_list, "file_id", "left").join(lines, "file_id", "left")
    body = F.struct(*[F.col(c) for c in whole.columns])
    return whole.select("report_id", "file_id", F.to_json(body).alias("document"))


DECISIONS = ("approved", "rejected")


def decide_approvals(decisions: DataFrame) -> DataFrame:
    """Decisions with their ``outcome``: the first of an approval is ``applied``, every later one a ``conflict``.

    Only the values in DECISIONS decide; a row with another value is ``refused`` and leaves the approval pending.
    The first decision is found by a partial aggregation and matched on the decision's own key, so
    an approval with very many decisions is not gathered.
    """
    valid = F.col("decision").isin(*DECISIONS)
    first = decisions.where(valid).groupBy("approval_id").agg(
        F.min(F.struct("decided_at", "event_id")).alias("first")).select(F.col("first.event_id").alias("event_id"),
                                                                        F.lit("applied").alias("outcome"))
    return decisions.join(first, "event_id", "left").withColumn(
        "outcome", F.when(~F.coalesce(valid, F.lit(False)), "refused").otherwise(F.coalesce("outcome", F.lit("conflict"))))


def decided_approvals(approvals: DataFrame, decided: DataFrame) -> DataFrame:
    """Approvals as stored after the decisions: status, reviewer, reason and time of the one that was applied."""
    final = decided.where("outcome = 'applied'").selectExpr("approval_id", "decision", "reviewer", "reason", "decided_at")
    return approvals.drop("status").join(final, "approval_id", "left").withColumn(
        "status", F.coalesce("decision", F.lit("pending_review"))).drop("decision")


def reports_with_approval(reports: DataFrame, approvals: DataFrame, decided: DataFrame) -> DataFrame:
    """Reports with their approval and its status; of several approvals of a report the first, by time of creation if known."""
    final = decided.filter("outcome = 'applied'").select("approval_id", "decision", "decided_at")
    age = [c for c in ("created_at", "approval_id") if c in approvals.columns]
    first = approvals.groupBy("report_id").agg(F.min(F.struct(*age)).alias("_first")).select("report_id", "_first.approval_id")
    tasks = first.join(final, "approval_id", "left")
    return reports.join(tasks, "report_id", "left").withColumn(
        "status", F.when(F.col("approval_id").isNotNull(), F.coalesce("decision", F.lit("pending_review"))))
