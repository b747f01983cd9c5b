"""Reports, evaluation, approvals, listings and dashboard."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions.ids import stable_id
from fleetgauge.operators import dashboard, evaluation as el, evidence as evi, gates, listings, reports as rp
from fleetgauge.operators import verification as vf
from fleetgauge.operators.segments import ranked
from fleetgauge.plans import fixtures as fx
from fleetgauge.plans import report_views as rv  # noqa: F401  (adds the views)
from fleetgauge.plans.registry import r6, register, rounded
from fleetgauge.plans.telemetry_queries import _analysis, stored_analysis
from fleetgauge.plans.verification_queries import verdicts, verified
from fleetgauge.policies import ReleaseThresholds
from fleetgauge.session import shared_folder, stored
from fleetgauge.sources import reports as sinks
from fleetgauge.sources import tables

# --- evidence and reports per log ---------------------------------------------------------------


@register("build_evidence", "SELECT * FROM v_items")
def build_evidence(spark, sf_dir):
    return evi.evidence_items(stored_analysis(spark, sf_dir))


@register("evidence_union", "SELECT kind, count(*) AS items, count(t_s) AS timestamped FROM v_items GROUP BY 1")
def evidence_union(spark, sf_dir):
    return evi.evidence_items(stored_analysis(spark, sf_dir)).groupBy("kind").agg(
        F.count(F.lit(1)).alias("items"), F.count("t_s").alias("timestamped"))


@register("missing_evidence", "SELECT file_id, name || ': ' || missing_reason AS item FROM v_mrows WHERE NOT available")
def missing_evidence(spark, sf_dir):
    return evi.missing_items(_analysis(spark, sf_dir).metrics).select("file_id", "item")


@register("metrics_table", """
SELECT file_id, metric_index, CASE WHEN available THEN metric_id END AS metric_id, name, observed, unit, limit_text AS threshold, passed, t_s, missing_reason FROM v_mrows""")
def metrics_table(spark, sf_dir):
    return rp.metrics_table(_analysis(spark, sf_dir).metrics)


@register("timeline", "SELECT * FROM v_timeline")
def timeline(spark, sf_dir):
    a = stored_analysis(spark, sf_dir)
    return rp.timeline(a.events, a.metrics)


def _registry(items):
    source = "IF(kind IN ('metric', 'event', 'window'), 'telemetry', kind) AS source"
    return items.selectExpr("file_id", "evidence_id", "kind", source, "summary", "t_s")


@register("evidence_appendix", """
SELECT DISTINCT t.file_id, t.evidence_id, i.kind, 'telemetry' AS source, i.summary, i.t_s FROM v_timeline t JOIN v_items i ON t.file_id = i.file_id AND t.evidence_id = i.evidence_id""")
def evidence_appendix(spark, sf_dir):
    a = stored_analysis(spark, sf_dir)
    return rp.evidence_appendix(rp.timeline(a.events, a.metrics), _registry(evi.evidence_items(a))).drop("place")


@register("executive_summary", "SELECT file_id, summary FROM v_summary")
def executive_summary(spark, sf_dir):
    return rp.executive_summary(_analysis(spark, sf_dir).metrics).select(
        "file_id", F.array_join("lines", " ").alias("summary"))


@register("report_rows", "SELECT * FROM v_header")
def report_rows(spark, sf_dir):
    return rp.report_rows(stored_analysis(spark, sf_dir)).select(
        "report_id", "file_id", "quality_id", "report_confidence", "source_path", "data_origin", "rows", "duration_s",
        "sample_rate_hz", "quality_verdict", "primary_window", F.array_join("limitations", " | ").alias("limitations"))


@register("report_json_sink", """
SELECT h.report_id, h.file_id, s.summary, m.n AS metric_rows, t.n AS timeline_rows FROM v_header h JOIN v_summary s ON s.file_id = h.file_id
JOIN (SELECT file_id, count(*) AS n FROM v_mrows GROUP BY 1) m ON m.file_id = h.file_id JOIN (SELECT file_id, count(*) AS n FROM v_timeline GROUP BY 1) t ON t.file_id = h.file_id""")
def report_json_sink(spark, sf_dir):
    """The documents of the JSON sink, read back field by field."""
    a = stored_analysis(spark, sf_dir)
    documents = rp.report_documents(
        rp.report_rows(a), rp.executive_summary(a.metrics), rp.metrics_table(a.metrics),
        rp.timeline(a.events, a.metrics))
    parsed = F.from_json("document", "lines ARRAY<STRING>, metrics_table ARRAY<STRING>, timeline ARRAY<STRING>")
    return documents.withColumn("d", parsed).select(
        "report_id", "file_id", F.array_join("d.lines", " ").alias("summary"),
        F.size("d.metrics_table").cast("bigint").alias("metric_rows"),
        F.size("d.timeline").cast("bigint").alias("timeline_rows"))


@register("report_traceability", "SELECT file_id AS key, '' AS evidence_id FROM v_files WHERE 1 = 0")
def report_traceability(spark, sf_dir):
    """Ids in the summaries that do not resolve: none, or the reports would be refused."""
    a = stored_analysis(spark, sf_dir)
    texts = rp.executive_summary(a.metrics).selectExpr("file_id AS key", "array_join(lines, ' ') AS text")
    own = a.quality.selectExpr("file_id AS key", "quality_id AS evidence_id")
    return vf.assert_traceable(texts, evi.evidence_items(a), own).select("key", "evidence_id")


# --- deterministic evaluation per log ---------------------------------------------------------------


def _cases(spark, sf_dir):
    files = fx.provenance(spark, sf_dir).selectExpr(
        "file_id as case_id", "cast(right(file_id, 12) as bigint) % 12 as cls")
    brake, cross, crash = (f"'{e}'" for e in (v.EV_BRAKE, v.EV_CROSSING, v.EV_COLLISION))
    return files.selectExpr(
        "case_id", "cls",
        "case when cls in (0, 1, 2) then 'pass' when cls in (3, 4, 6, 10) then 'degraded' else 'blocked' end as expected_quality",
        "case when cls in (0, 3, 6, 10) then 'nominal' when cls in (1, 2, 4) then 'fault' else 'blocked' end as expected_outcome",
        f"case when cls in (1, 4) then array({brake}, {cross}, {crash}) when cls in (0, 2, 6, 10) then array({brake}, {cross}) "
        f"when cls = 3 then array({cross}) else cast(array() as array<string>) end as expected_events",
        f"case when cls in (0, 2, 6, 10) then array({crash}) when cls = 3 then array({brake}) "
        "else cast(array() as array<string>) end as forbidden_events",
        "case when cls in (0, 6, 10) then map('braking_latency_s', true, 'collision', true) "
        "when cls = 2 then map('braking_latency_s', false, 'collision', true) "
        "when cls in (1, 4) then map('braking_latency_s', false, 'collision', false) "
        "when cls = 3 then map('min_ttc_s', true, 'braking_latency_s', true) "
        "else cast(map() as map<string,boolean>) end as expected_metric_verdicts")


def _deterministic(spark, sf_dir):
    a, cases = stored_analysis(spark, sf_dir), _cases(spark, sf_dir)
    errors = gates.blocked(a.quality).selectExpr("file_id as case_id", "reason as error")
    return (
        el.check_blocked(cases, errors)
        .unionByName(el.check_quality(cases, gates.analyzable(a.quality)))
        .unionByName(el.check_events(cases, a.events))
        .unionByName(el.check_metric_verdicts(cases, a.metrics)))


@register("check_blocked", "SELECT * FROM v_det_checks WHERE name = 'quality_blocked'")
def check_blocked(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    errors = gates.blocked(a.quality).selectExpr("file_id as case_id", "reason as error")
    return el.check_blocked(_cases(spark, sf_dir), errors)


@register("check_deterministic", "SELECT * FROM v_det_checks")
def check_deterministic(spark, sf_dir):
    return _deterministic(spark, sf_dir)


@register("case_expectations", "SELECT * FROM v_det_checks WHERE name LIKE 'event%' OR name LIKE 'metric:%'")
def case_expectations(spark, sf_dir):
    a, cases = stored_analysis(spark, sf_dir), _cases(spark, sf_dir)
    return el.check_events(cases, a.events).unionByName(el.check_metric_verdicts(cases, a.metrics))


def _truth(spark, sf_dir):
    return _cases(spark, sf_dir).filter("expected_quality <> 'blocked'").selectExpr(
        "case_id", "cls in (1, 4) as collision",
        "case when cls <> 3 then case when cls in (1, 4) then 556e-2 when cls = 2 then 530e-2 else 492e-2 end - 474e-2 end "
        "as braking_latency_s")


@register("ground_truth_join", "SELECT * FROM v_truth_checks")
def ground_truth_join(spark, sf_dir):
    return el.check_ground_truth(_truth(spark, sf_dir), _analysis(spark, sf_dir).metrics)


# --- evaluation of agent runs -------------------------------------------------------------------


class _AgentEval:
    """Cases, checks and results over all runs; the verified hypotheses are stored once."""

    def __init__(self, spark, sf_dir):
        self.verified = stored(verified(spark, sf_dir), "verified")
        self.verdicts = stored(vf.run_verdicts(fx.runs(spark, sf_dir), self.verified), "verdicts")
        self.cases = fx.runs(spark, sf_dir).selectExpr(
            "run_id as case_id", "expected_outcome", "max_report_confidence", "quality_verdict", "baseline_passed",
            "latency_s", "prompt_tokens", "completion_tokens",
            "if(cast(right(run_id, 12) as bigint) % 2 = 0, array('perception_error', 'fusion_error'), array('planner_logic_error')) as acceptable_classes",
            "case when cast(right(run_id, 12) as bigint) % 97 = 0 then 'provider unavailable' end as error"
        ).withColumn("agent_ran", F.expr("quality_verdict <> 'blocked' and error is null"))
        self.checks = el.check_agent(
            self.cases.filter("agent_ran"), self.verdicts, vf.rank_hypotheses(self.verified))
        self.results = el.case_status(self.cases, self.checks).join(
            self.verdicts.selectExpr("run_id as case_id", "evidence_support_rate", "unsupported_claim_rate",
                                     "human_review_required"), "case_id")


@register("check_agent", "SELECT * FROM v_agent_checks")
def check_agent(spark, sf_dir):
    return _AgentEval(spark, sf_dir).checks


@register("case_status", "SELECT case_id, status FROM v_eresults")
def case_status(spark, sf_dir):
    return _AgentEval(spark, sf_dir).results.select("case_id", "status")


_RATES = ("top1_accuracy", "false_fault_rate", "mean_evidence_support_rate", "max_unsupported_claim_rate",
          "latency_p50_s", "latency_p95_s")


@register("eval_aggregates", """
SELECT n_cases, n_passed, n_failed, n_errors, n_agent_cases, n_fault_cases_scored, n_nominal_cases_scored, round(top1_accuracy, 6) AS top1_accuracy,
  round(false_fault_rate, 6) AS false_fault_rate, round(mean_evidence_support_rate, 6) AS mean_evidence_support_rate,
  round(max_unsupported_claim_rate, 6) AS max_unsupported_claim_rate, prompt_tokens, completion_tokens, n_human_review_required,
  round(latency_p50_s, 6) AS latency_p50_s, round(latency_p95_s, 6) AS latency_p95_s FROM v_eagg, v_tails""")
def eval_aggregates(spark, sf_dir):
    e = _AgentEval(spark, sf_dir)
    return rounded(el.eval_aggregates(e.results, e.checks), *_RATES)


@register("nearest_rank_percentile", "SELECT round(latency_p50_s, 6) AS p50, round(latency_p95_s, 6) AS p95 FROM v_tails")
def nearest_rank_percentile(spark, sf_dir):
    ran = _AgentEval(spark, sf_dir).cases.filter("agent_ran")
    return rounded(el.nearest_rank_percentiles(ran, "latency_s", {"p50": 0.5, "p95": 0.95}), "p50", "p95")


_BARS = ReleaseThresholds(min_top1_accuracy=0.5, max_false_fault_rate=0.25)


@register("release_gate", """
SELECT case_id AS scope, 'error: ' || error AS failure FROM v_eresults WHERE status = 'error'
UNION ALL SELECT case_id, name || ': ' || detail FROM v_det_checks WHERE NOT passed
UNION ALL SELECT 'aggregate', 'unsupported_claim_rate ' || printf('%.2f', max_unsupported_claim_rate) || ' > 0.10' FROM v_eagg WHERE max_unsupported_claim_rate > 1e-1
UNION ALL SELECT 'aggregate', 'evidence_support_rate ' || printf('%.2f', mean_evidence_support_rate) || ' < 0.90' FROM v_eagg WHERE mean_evidence_support_rate < 9e-1
UNION ALL SELECT 'aggregate', 'top1_accuracy ' || printf('%.2f', top1_accuracy) || ' < 0.50' FROM v_eagg WHERE top1_accuracy < 5e-1
UNION ALL SELECT 'aggregate', 'false_fault_rate ' || printf('%.2f', false_fault_rate) || ' > 0.25' FROM v_eagg WHERE false_fault_rate > 25e-2""")
def release_gate(spark, sf_dir):
    e = _AgentEval(spark, sf_dir)
    return el.release_gate(e.results, _deterministic(spark, sf_dir), el.eval_aggregates(e.results, e.checks), _BARS)


@register("release_gate_whole", """
SELECT case_id AS scope, 'error: ' || error AS failure FROM v_eresults WHERE status = 'error'
UNION ALL SELECT case_id, name || ': ' || detail FROM v_det_checks WHERE NOT passed
UNION ALL SELECT case_id, name || ': ' || detail FROM v_truth_checks WHERE NOT passed
UNION ALL SELECT 'aggregate', 'unsupported_claim_rate ' || printf('%.2f', max_unsupported_claim_rate) || ' > 0.10' FROM v_eagg WHERE max_unsupported_claim_rate > 1e-1
UNION ALL SELECT 'aggregate', 'evidence_support_rate ' || printf('%.2f', mean_evidence_support_rate) || ' < 0.90' FROM v_eagg WHERE mean_evidence_support_rate < 9e-1
UNION ALL SELECT case_id, case_id || ' passed in baseline, now ' || status FROM v_eresults WHERE baseline_passed AND status <> 'pass'""")
def release_gate_whole(spark, sf_dir):
    """The gate with ground truth, and with a baseline that was stored, read again and compared by its suite's hash."""
    e, cases = _AgentEval(spark, sf_dir), _cases(spark, sf_dir)
    path, digest = _table(spark, "evaluation"), el.suite_fingerprint(cases).first().suite_sha256
    aggregates = el.eval_aggregates(e.results, e.checks)
    sinks.write_evaluation(_baseline(e), aggregates, path)
    before, old = sinks.read_evaluation(spark, path, _baseline(e).schema, aggregates.schema)
    failures = el.baseline_compare(e.results, aggregates, digest, before, old, digest, "eval_1")
    checks = _deterministic(spark, sf_dir).unionByName(el.check_ground_truth(_truth(spark, sf_dir), _analysis(spark, sf_dir).metrics))
    return el.release_gate(e.results, checks, aggregates, baseline_failures=failures)


@register("baseline_refused", "SELECT 'suite' AS scope, 'baseline eval_1 was produced by a different suite' AS failure")
def baseline_refused(spark, sf_dir):
    """A baseline of a suite in which one case differs is refused, whatever its results."""
    e, cases = _AgentEval(spark, sf_dir), _cases(spark, sf_dir)
    changed = cases.withColumn("expected_quality", F.when(F.col("cls") == 5, "pass").otherwise(F.col("expected_quality")))
    now, then = (el.suite_fingerprint(c).first().suite_sha256 for c in (cases, changed))
    aggregates = el.eval_aggregates(e.results, e.checks)
    refused = el.baseline_compare(e.results, aggregates, now, _baseline(e), aggregates, then, "eval_1")
    return refused.select("scope", F.regexp_extract("failure", r"^[^(]*suite", 0).alias("failure"))


def _baseline(e: _AgentEval):
    return e.cases.selectExpr("case_id", "if(baseline_passed, 'pass', 'fail') as status")


@register("baseline_regressions", """
SELECT case_id AS scope, case_id || ' passed in baseline, now ' || status AS failure FROM v_eresults WHERE baseline_passed AND status <> 'pass'""")
def baseline_regressions(spark, sf_dir):
    e = _AgentEval(spark, sf_dir)
    return el.baseline_regressions(e.results, _baseline(e))


@register("baseline_compare", """
SELECT case_id AS scope, case_id || ' passed in baseline, now ' || status AS failure FROM v_eresults WHERE baseline_passed AND status <> 'pass'
UNION ALL SELECT 'aggregate', 'top1_accuracy regressed: ' || printf('%.3f', top1_accuracy) || ' vs baseline 0.900' FROM v_eagg WHERE top1_accuracy < 9e-1
UNION ALL SELECT 'aggregate', 'false_fault_rate regressed: ' || printf('%.3f', false_fault_rate) || ' vs baseline 0.100' FROM v_eagg WHERE false_fault_rate > 1e-1
UNION ALL SELECT 'aggregate', 'mean_evidence_support_rate regressed: ' || printf('%.3f', mean_evidence_support_rate) || ' vs baseline 0.850' FROM v_eagg WHERE mean_evidence_support_rate < 85e-2
UNION ALL SELECT 'aggregate', 'max_unsupported_claim_rate regressed: ' || printf('%.3f', max_unsupported_claim_rate) || ' vs baseline 0.200' FROM v_eagg WHERE max_unsupported_claim_rate > 2e-1""")
def baseline_compare(spark, sf_dir):
    e = _AgentEval(spark, sf_dir)
    aggregates = el.eval_aggregates(e.results, e.checks)
    before = e.cases.agg(F.lit(0.9).alias("top1_accuracy"), F.lit(0.1).alias("false_fault_rate"),
                         F.lit(0.85).alias("mean_evidence_support_rate"), F.lit(0.2).alias("max_unsupported_claim_rate"))
    return el.baseline_compare(e.results, aggregates, "a" * 64, _baseline(e), before, "a" * 64, "eval_1")


def _fingerprint_sql():
    level = "SELECT sha256(t) AS place, sha256(sha256(t) || '*' || count(*)) AS d, count(*) AS n FROM texts GROUP BY t"
    for digits in el.LEVELS:
        level = f"SELECT substr(place, 1, {digits}) AS place, sha256(string_agg(d, '' ORDER BY d)) AS d, sum(n) AS n FROM ({level}) x GROUP BY 1"
    lists = {name: f"'(' || coalesce(string_agg('[\"' || event_type || '\"]', ';' ORDER BY event_type) FILTER (WHERE want = {want}), '') || ')'"
             for name, want in (("expected_events", "true"), ("forbidden_events", "false"))}
    return f"""
SELECT d AS suite_sha256, CAST(n AS BIGINT) AS cases FROM (WITH texts AS (
  SELECT '{{case_id:["' || c.case_id || '"];cls:[' || CAST(cls AS VARCHAR) || '];expected_events:' || coalesce(e.expected_events, '()')
    || ';expected_metric_verdicts:{{' || coalesce(m.verdicts, '') || '}};expected_outcome:["' || expected_outcome || '"];expected_quality:["' || expected_quality
    || '"];forbidden_events:' || coalesce(e.forbidden_events, '()') || ';steps:(' || '{{at:[' || CAST(cls AS VARCHAR) || '];name:["b"];tags:{{["k"]:(["x"];["y"])}}}}'
    || ';' || '{{at:null;name:["a"];tags:{{}}}})}}' AS t
  FROM v_cases c LEFT JOIN (SELECT case_id, {lists['expected_events']} AS expected_events, {lists['forbidden_events']} AS forbidden_events
      FROM v_expected_events GROUP BY 1) e ON e.case_id = c.case_id
  LEFT JOIN (SELECT case_id, string_agg('["' || metric || '"]:[' || CASE WHEN expected THEN 'true' ELSE 'false' END || ']', ';' ORDER BY metric) AS verdicts
      FROM v_expected_metrics GROUP BY 1) m ON m.case_id = c.case_id)
{level}) y"""


@register("suite_fingerprint", _fingerprint_sql())
def suite_fingerprint(spark, sf_dir):
    """Cases with nested steps: a list of structs that hold maps of string lists."""
    steps = ("array(named_struct('name', 'b', 'at', cls, 'tags', map('k', array('y', 'x'))), "
             "named_struct('name', 'a', 'at', CAST(NULL AS INT), 'tags', CAST(map() AS MAP<STRING, ARRAY<STRING>>))) AS steps")
    return el.suite_fingerprint(_cases(spark, sf_dir).withColumn("cls", F.col("cls").cast("int")).selectExpr("*", steps))


@register("select_cases", """
SELECT case_id FROM v_ecases WHERE case_id IN (SELECT concat('run_', lpad(CAST(o_custkey AS VARCHAR(12)), 12, '0')) FROM orders WHERE o_totalprice > 2e5)""")
def select_cases(spark, sf_dir):
    cases = fx.runs(spark, sf_dir).selectExpr("run_id as case_id")
    return el.select_cases(cases, _wanted(spark, sf_dir, "o_totalprice > 2e5"))


def _wanted(spark, sf_dir, condition):
    return fx.table(spark, sf_dir, "orders").filter(condition).selectExpr(
        "concat('run_', lpad(cast(o_custkey as string), 12, '0')) as case_id")


@register("unknown_cases", """
SELECT DISTINCT concat('run_', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS case_id FROM events
WHERE concat('run_', lpad(CAST(event_id AS VARCHAR), 12, '0')) NOT IN (SELECT run_id FROM v_runs)""")
def unknown_cases(spark, sf_dir):
    wanted = fx.table(spark, sf_dir, "events").selectExpr(
        "concat('run_', lpad(cast(event_id as string), 12, '0')) as case_id")
    return el.unknown_cases(fx.runs(spark, sf_dir).selectExpr("run_id as case_id"), wanted)


# --- stored runs, approvals, listings, dashboard --------------------------------------------------


def _reports(spark, sf_dir):
    runs = fx.runs(spark, sf_dir).select("run_id", "project_id")
    return verdicts(spark, sf_dir).join(runs, "run_id").select(
        stable_id("report", F.col("run_id")).alias("report_id"), "run_id", "project_id",
        F.expr("concat('appr_', cast(cast(right(run_id, 12) as bigint) as string)) as approval_id"),
        "report_confidence", "human_review_required", F.lit("").alias("review_reasons"))


@register("run_append", """
SELECT run_id, project_id, verification_id, report_confidence, human_review_required, round(support, 6) AS evidence_support_rate, prompt_tokens, completion_tokens,
  round(latency_s, 6) AS latency_s FROM v_verdicts""")
def run_append(spark, sf_dir):
    runs = fx.runs(spark, sf_dir).select("run_id", "project_id", "prompt_tokens", "completion_tokens", "latency_s")
    rows = verdicts(spark, sf_dir).join(runs, "run_id").select(
        "run_id", "project_id", "verification_id", "report_confidence", "human_review_required",
        "evidence_support_rate", "prompt_tokens", "completion_tokens", "latency_s")
    rows = stored(rounded(rows, "evidence_support_rate", "latency_s"), "runs")
    path = _table(spark, "runs")
    tables.append_runs(rows, path, 8)
    tables.append_runs(rows.where(F.pmod(F.hash("run_id"), F.lit(3)) == 0), path, 8)  # a repeated job
    return spark.read.parquet(path).drop("bucket")


def _table(spark, name):
    return f"{shared_folder(spark)}/fleetgauge-{name}-{uuid.uuid4().hex}"


@register("report_append", f"""
SELECT 'appr_' || substr({rv.stable_id('run', 'report_id')}, 5, 12) AS approval_id, project_id, report_id, 'pending_review' AS status, human_review_required FROM v_reports""")
def report_append(spark, sf_dir):
    reports = stored(_reports(spark, sf_dir).drop("approval_id"), "reports")
    path = _table(spark, "reports")
    for _ in range(2):  # the second time as in a repeated job
        tables.append_reports(reports, path, f"{path}-approvals", 8)
    return spark.read.parquet(f"{path}-approvals").drop("review_reasons", "bucket")


def _created(key):
    """A time of creation that the caller of the store would give."""
    return F.expr(f"timestamp_seconds(1700000000 + CAST(right({key}, 12) AS BIGINT) * 37 % 86400)").alias("created_at")


_CREATED = "CAST(to_timestamp(1700000000 + CAST(right(run_id, 12) AS BIGINT) * 37 % 86400) AT TIME ZONE 'UTC' AS VARCHAR)"


def _listed(rows, key, **equal):
    """Newest first, with the place in the listing."""
    order = [F.desc("created_at"), F.col(key)]
    shown = listings.list_filtered(rows, order, **equal)
    return ranked(shown.withColumn("_all", F.lit(0)), ["_all"], order, -F.floor(F.unix_timestamp("created_at") / 60), "place").drop("_all")


@register("list_runs", f"""
SELECT run_id, report_confidence, row_number() OVER (ORDER BY {_CREATED} DESC, run_id) - 1 AS place FROM v_verdicts WHERE project_id = 'proj_3'""")
def list_runs(spark, sf_dir):
    runs = verdicts(spark, sf_dir).join(fx.runs(spark, sf_dir).select("run_id", "project_id"), "run_id").select("*", _created("run_id"))
    return _listed(runs, "run_id", project_id="proj_3").select("run_id", "report_confidence", "place")


@register("list_projects", f"""
SELECT project_id, row_number() OVER (ORDER BY c DESC, project_id) - 1 AS place FROM (SELECT project_id, max({_CREATED}) AS c FROM v_runs GROUP BY 1) x""")
def list_projects(spark, sf_dir):
    runs = fx.runs(spark, sf_dir).select("project_id", _created("run_id"))
    return _listed(runs.groupBy("project_id").agg(F.max("created_at").alias("created_at")), "project_id").select("project_id", "place")


@register("list_files", """
SELECT file_id, row_number() OVER (ORDER BY CAST(right(file_id, 12) AS BIGINT) * 37 % 86400 DESC, file_id) - 1 AS place FROM v_files""")
def list_files(spark, sf_dir):
    return _listed(fx.provenance(spark, sf_dir).select("file_id", _created("file_id")), "file_id").select("file_id", "place")


@register("list_metrics", """
SELECT file_id, metric_id, name FROM v_metrics WHERE value IS NOT NULL OR value_bool IS NOT NULL""")
def list_metrics(spark, sf_dir):
    stored_rows = tables.stored_metrics(_analysis(spark, sf_dir).metrics)
    return listings.list_filtered(stored_rows, [F.col("file_id"), F.col("name")]).select("file_id", "metric_id", "name")


@register("list_reports", f"""
SELECT r.report_id, coalesce(d.decision, 'pending_review') AS status, row_number() OVER (ORDER BY {_CREATED.replace('run_id', 'r.run_id')} DESC, r.report_id) - 1 AS place
FROM v_reports r LEFT JOIN v_decisions d ON d.approval_id = r.approval_id AND d.outcome = 'applied' WHERE r.project_id = 'proj_3'""")
def list_reports(spark, sf_dir):
    reports = _reports(spark, sf_dir).select("*", _created("run_id"))
    joined = rp.reports_with_approval(reports.drop("approval_id"), reports.select("approval_id", "report_id"),
                                      rp.decide_approvals(fx.decisions(spark, sf_dir)))
    return _listed(joined, "report_id", project_id="proj_3").select("report_id", "status", "place")


@register("list_approvals", f"""
SELECT r.approval_id, d.reviewer, row_number() OVER (ORDER BY {_CREATED.replace('run_id', 'r.run_id')} DESC, r.approval_id) - 1 AS place
FROM v_reports r JOIN v_decisions d ON d.approval_id = r.approval_id AND d.outcome = 'applied' WHERE d.decision = 'approved'""")
def list_approvals(spark, sf_dir):
    approvals = _reports(spark, sf_dir).select("approval_id", "report_id", _created("run_id"))
    done = rp.decided_approvals(approvals.withColumn("status", F.lit("pending_review")), rp.decide_approvals(fx.decisions(spark, sf_dir)))
    return _listed(done, "approval_id", status="approved").select("approval_id", "reviewer", "place")


@register("approval_decide", "SELECT approval_id, event_id, decision, outcome FROM v_decisions")
def approval_decide(spark, sf_dir):
    return rp.decide_approvals(fx.decisions(spark, sf_dir)).select("approval_id", "event_id", "decision", "outcome")


@register("approvals_decided", """
SELECT r.approval_id, r.report_id, coalesce(d.decision, 'pending_review') AS status, d.reviewer, d.reason, CAST(d.decided_at AS VARCHAR) AS decided_at
FROM v_reports r LEFT JOIN v_decisions d ON d.approval_id = r.approval_id AND d.outcome = 'applied'""")
def approvals_decided(spark, sf_dir):
    approvals = _reports(spark, sf_dir).select("approval_id", "report_id")
    done = rp.decided_approvals(approvals, rp.decide_approvals(fx.decisions(spark, sf_dir)))
    return done.select("approval_id", "report_id", "status", "reviewer", "reason", F.col("decided_at").cast("string").alias("decided_at"))


@register("reports_with_approval", """
SELECT r.report_id, r.report_confidence, coalesce(d.decision, 'pending_review') AS status FROM v_reports r LEFT JOIN v_decisions d ON d.approval_id = r.approval_id AND d.outcome = 'applied'""")
def reports_with_approval(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    decided = rp.decide_approvals(fx.decisions(spark, sf_dir))
    joined = rp.reports_with_approval(reports.drop("approval_id"), reports.select("approval_id", "report_id"), decided)
    return joined.select("report_id", "report_confidence", "status")


@register("list_filtered", """
SELECT event_id, approval_id, decision FROM v_decisions WHERE decision = 'rejected'""")
def list_filtered(spark, sf_dir):
    return listings.list_filtered(
        fx.decisions(spark, sf_dir), [F.desc("decided_at"), F.col("event_id")], decision="rejected"
    ).select("event_id", "approval_id", "decision")


@register("list_events", "SELECT file_id, event_id, event_type, t_s FROM v_aevents")
def list_events(spark, sf_dir):
    return listings.list_filtered(_analysis(spark, sf_dir).events, [F.col("t_s"), F.col("event_id")]).select(
        "file_id", "event_id", "event_type", "t_s")


@register("dashboard_summary", """
SELECT 'projects' AS measure, count(DISTINCT project_id) * 1e0 AS value FROM v_runs
UNION ALL SELECT 'files', count(*) * 1e0 FROM v_files
UNION ALL SELECT 'reports', count(*) * 1e0 FROM v_reports
UNION ALL SELECT 'approvals_pending', count(*) * 1e0 FROM v_reports r LEFT JOIN v_decisions d ON d.approval_id = r.approval_id AND d.outcome = 'applied' WHERE d.decision IS NULL
UNION ALL SELECT 'agent_runs', count(*) * 1e0 FROM v_verdicts
UNION ALL SELECT 'avg_evidence_support_rate', round(avg(support), 6) FROM v_verdicts
UNION ALL SELECT 'llm_prompt_tokens', CAST(sum(prompt_tokens) AS DOUBLE) FROM v_verdicts
UNION ALL SELECT 'llm_completion_tokens', CAST(sum(completion_tokens) AS DOUBLE) FROM v_verdicts
UNION ALL SELECT 'reports_by_confidence:' || report_confidence, count(*) * 1e0 FROM v_reports GROUP BY report_confidence""")
def dashboard_summary(spark, sf_dir):
    reports = stored(_reports(spark, sf_dir), "reports")
    approvals = rp.reports_with_approval(
        reports.drop("approval_id"), reports.select("approval_id", "report_id"),
        rp.decide_approvals(fx.decisions(spark, sf_dir)))
    runs = fx.runs(spark, sf_dir)
    stored_runs = verdicts(spark, sf_dir).join(runs.select("run_id", "prompt_tokens", "completion_tokens"), "run_id")
    return rounded(dashboard.dashboard_summary(
        runs.select("project_id").distinct(), fx.provenance(spark, sf_dir), stored_runs, reports, approvals), "value")


@register("call_usage", """
SELECT provider, model, kind, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, round(sum(latency_s), 6) AS total_latency_s, count(*) FILTER (WHERE NOT ok) AS failures
FROM (SELECT 'provider_' || (conv_id % 2) AS provider, 'model_' || (conv_id % 3) AS model,
  CASE role WHEN 'assistant' THEN 'structured' WHEN 'user' THEN 'completion' ELSE 'embedding' END AS kind,
  greatest(1, CAST(floor(length(text) / 4e0) AS INT)) AS prompt_tokens, length(text) / 1e3 AS latency_s, turn % 7 <> 6 AS ok FROM conversations) x GROUP BY provider, model, kind""")
def call_usage(spark, sf_dir):
    return dashboard.call_usage(fx.calls(spark, sf_dir)).withColumn("total_latency_s", r6("total_latency_s"))
