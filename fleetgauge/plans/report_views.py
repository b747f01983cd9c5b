"""DuckDB views for reports, evaluation and dashboard."""

from __future__ import annotations

from fleetgauge import vocab as v
from fleetgauge.plans.views import VIEWS, stable_id

_OBSERVED = "CASE WHEN value_bool THEN 'yes' WHEN NOT value_bool THEN 'no' WHEN value IS NULL THEN '—' ELSE printf('%.3f', value) END"
_HAVE = "(value IS NOT NULL OR value_bool IS NOT NULL)"
VIEWS["v_mrows"] = f"""
SELECT *, {_OBSERVED} AS observed, {_HAVE} AS available,
  CASE WHEN comparator IS NULL THEN '' ELSE comparator || ' ' || CASE WHEN threshold_bool IS NOT NULL THEN CAST(threshold_bool AS VARCHAR) ELSE CAST(threshold AS VARCHAR) END END AS limit_text
FROM v_metrics"""
VIEWS["v_timeline"] = """
SELECT file_id, t_s, event_id AS evidence_id, 'event' AS kind, event_type || ': ' || description AS description FROM v_aevents
UNION ALL SELECT file_id, t_s, metric_id, 'metric', name || ' = ' || observed || ' ' || unit || ' (' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || ' ' || limit_text || ')'
FROM v_mrows WHERE available AND t_s IS NOT NULL AND comparator IS NOT NULL"""
VIEWS["v_items"] = """
SELECT p.file_id, p.file_id AS evidence_id, 'file' AS kind, f.source_path || '; ' || CAST(n_rows AS VARCHAR) || ' rows; duration ' || CAST(extent_s AS VARCHAR) || 's; conversions: none' AS summary,
  CAST(NULL AS DOUBLE) AS t_s, CAST(NULL AS BOOLEAN) AS passed
FROM v_prof p JOIN v_files f ON p.file_id = f.file_id JOIN v_quality q ON p.file_id = q.file_id WHERE q.verdict <> 'blocked'
UNION ALL SELECT file_id, quality_id, 'quality', 'verdict ' || verdict || ': ' || gate_summary, NULL, true FROM v_quality WHERE verdict <> 'blocked'
UNION ALL SELECT file_id, event_id, 'event', event_type || ': ' || description, t_s, NULL FROM v_aevents
UNION ALL SELECT w.file_id, w.window_id, 'window', printf('%.2f', start_s) || 's..' || printf('%.2f', end_s) || 's around event ' || event_id || ' (' || CAST(sample_count AS VARCHAR) || ' samples)'
    || CASE WHEN w.clipped_start OR w.clipped_end THEN ' (clipped to log)' ELSE '' END || CASE WHEN w.window_id = p.window_id THEN ' PRIMARY' ELSE '' END, t_event_s, NULL
  FROM v_windows w JOIN v_primary p ON w.file_id = p.file_id
UNION ALL SELECT file_id, metric_id, 'metric', name || ' = ' || observed || ' ' || unit || CASE WHEN comparator IS NOT NULL THEN ' (threshold ' || comparator || ' '
    || CASE WHEN threshold_bool IS NOT NULL THEN CASE WHEN threshold_bool THEN 'True' ELSE 'False' END ELSE CAST(threshold AS VARCHAR) END || ')' ELSE '' END || '; method: ' || method, t_s, passed
  FROM v_mrows WHERE available"""


def _m(name: str) -> str:
    return f"SELECT file_id, observed, metric_id, passed, value, value_bool, threshold FROM v_mrows WHERE name = '{name}' AND available"


VIEWS["v_summary"] = f"""
SELECT f.file_id, concat_ws(' ',
  CASE WHEN c.file_id IS NOT NULL AND b.file_id IS NOT NULL AND l.file_id IS NOT NULL THEN
    'The AEB brake command at ' || b.observed || ' s followed the TTC threshold crossing at ' || c.observed || ' s by ' || l.observed || ' s against a limit of '
    || CAST(l.threshold AS VARCHAR) || ' s: ' || CASE WHEN l.passed THEN 'PASS' ELSE 'FAIL' END || ' [' || c.metric_id || ', ' || b.metric_id || ', ' || l.metric_id || '].'
  WHEN c.file_id IS NOT NULL AND b.file_id IS NULL THEN
    'TTC crossed the trigger threshold at ' || c.observed || ' s but no brake command was logged [' || c.metric_id || '].'
  ELSE 'No TTC threshold crossing was detected in this log; no AEB episode to assess.' END,
  CASE WHEN k.value_bool THEN 'A collision was recorded' || coalesce(' at ' || kt.observed || ' s', '') || ' [' || concat_ws(', ', k.metric_id, kt.metric_id) || '].'
  WHEN k.file_id IS NOT NULL THEN 'No collision was recorded [' || k.metric_id || '].' END,
  CASE WHEN t.file_id IS NOT NULL THEN 'Minimum TTC was ' || t.observed || ' s (' || CASE WHEN t.passed THEN 'PASS' ELSE 'FAIL' END || ' against >= ' || CAST(t.threshold AS VARCHAR) || ' s) [' || t.metric_id || '].' END,
  CASE WHEN d.value > 0 THEN 'Perception confidence was below the validity threshold for ' || d.observed || ' s of the risk phase [' || d.metric_id || '].' END,
  'No AI diagnosis was run; this is a metrics-only report. Root-cause hypotheses are not available.') AS summary
FROM (SELECT DISTINCT file_id FROM v_metrics) f
LEFT JOIN ({_m('ttc_threshold_crossing_s')}) c ON c.file_id = f.file_id LEFT JOIN ({_m('brake_command_time_s')}) b ON b.file_id = f.file_id
LEFT JOIN ({_m('braking_latency_s')}) l ON l.file_id = f.file_id LEFT JOIN ({_m('collision')}) k ON k.file_id = f.file_id
LEFT JOIN ({_m('collision_time_s')}) kt ON kt.file_id = f.file_id LEFT JOIN ({_m('min_ttc_s')}) t ON t.file_id = f.file_id
LEFT JOIN ({_m('confidence_dropout_during_risk_s')}) d ON d.file_id = f.file_id"""
VIEWS["v_header"] = f"""
SELECT {stable_id('report', 'p.file_id', 'q.quality_id', "''")} AS report_id, p.file_id, q.quality_id, 'low' AS report_confidence, f.source_path, f.data_origin,
  CAST(n_rows AS VARCHAR) AS rows, CAST(extent_s AS VARCHAR) AS duration_s, printf('%.1f', 1e0 / nominal) AS sample_rate_hz, q.verdict || ' (' || q.quality_id || ')' AS quality_verdict,
  coalesce(w.window_id, 'none') AS primary_window, concat_ws(' | ', '{v.NO_DIAGNOSIS_LIMITATION}',
    CASE WHEN f.data_origin = 'synthetic' THEN '{v.SYNTHETIC_LIMITATION}' END,
    CASE WHEN q.warnings <> '' THEN 'Data-quality warnings: ' || q.warnings END,
    CASE WHEN w.clipped_start OR w.clipped_end THEN 'The primary analysis window (' || w.window_id || ') was clipped to the log bounds; context before or after the event is incomplete.' END) AS limitations
FROM v_prof p JOIN v_quality q ON p.file_id = q.file_id JOIN v_files f ON p.file_id = f.file_id JOIN v_primary w ON w.file_id = p.file_id"""

# --- evaluation of the gates and metrics ------------------------------------------------------------
VIEWS["v_cases"] = """
SELECT file_id AS case_id, cls, CASE WHEN cls IN (0, 1, 2) THEN 'pass' WHEN cls IN (3, 4, 6, 10) THEN 'degraded' ELSE 'blocked' END AS expected_quality,
  CASE WHEN cls IN (0, 1, 2, 3, 4, 6, 10) THEN CASE WHEN cls IN (0, 3, 6, 10) THEN 'nominal' ELSE 'fault' END ELSE 'blocked' END AS expected_outcome FROM v_files"""
VIEWS["v_expected_events"] = """
SELECT c.case_id, e.event_type, e.want FROM v_cases c JOIN (
  SELECT unnest([0,1,2,4,6,10]) AS cls, 'aeb_brake_command' AS event_type, true AS want
  UNION ALL SELECT unnest([0,1,2,3,4,6,10]), 'ttc_threshold_crossing', true
  UNION ALL SELECT unnest([1,4]), 'collision', true
  UNION ALL SELECT unnest([0,2,6,10]), 'collision', false
  UNION ALL SELECT 3, 'aeb_brake_command', false) e ON c.cls = e.cls"""
VIEWS["v_expected_metrics"] = """
SELECT c.case_id, e.metric, e.expected FROM v_cases c JOIN (
  SELECT unnest([0,6,10]) AS cls, 'braking_latency_s' AS metric, true AS expected
  UNION ALL SELECT unnest([1,2,4]), 'braking_latency_s', false
  UNION ALL SELECT unnest([0,2,6,10]), 'collision', true
  UNION ALL SELECT unnest([1,4]), 'collision', false
  UNION ALL SELECT 3, 'min_ttc_s', true UNION ALL SELECT 3, 'braking_latency_s', true) e ON c.cls = e.cls"""
VIEWS["v_det_checks"] = """
SELECT c.case_id, CASE WHEN c.expected_outcome = 'blocked' THEN 'quality_blocked' ELSE 'quality_verdict' END AS name,
  c.expected_outcome = 'blocked' AND q.verdict = 'blocked' AS passed,
  CASE WHEN c.expected_outcome <> 'blocked' THEN 'expected ' || c.expected_quality || ', gates blocked: ' || 'analysis blocked by data-quality gates (' || quality_id || '): ' || failures
       WHEN q.verdict <> 'blocked' THEN 'gates let the file through; expected BLOCKED' ELSE 'analysis blocked by data-quality gates (' || quality_id || '): ' || failures END AS detail
FROM v_cases c JOIN v_quality q ON c.case_id = q.file_id WHERE q.verdict = 'blocked' OR c.expected_outcome = 'blocked'
UNION ALL SELECT c.case_id, 'quality_verdict', q.verdict = c.expected_quality, 'expected ' || c.expected_quality || ', got ' || q.verdict
FROM v_cases c JOIN v_quality q ON c.case_id = q.file_id WHERE q.verdict <> 'blocked'
UNION ALL SELECT x.case_id, CASE WHEN want THEN 'event_present:' ELSE 'event_absent:' END || x.event_type, want = (e.event_id IS NOT NULL),
  CASE WHEN want THEN CASE WHEN e.event_id IS NOT NULL THEN 'present' ELSE 'missing' END ELSE CASE WHEN e.event_id IS NOT NULL THEN 'present but forbidden' ELSE 'absent' END END
FROM v_expected_events x LEFT JOIN v_aevents e ON e.file_id = x.case_id AND e.event_type = x.event_type
UNION ALL SELECT x.case_id, 'metric:' || x.metric, coalesce(m.passed = x.expected, false),
  CASE WHEN m.file_id IS NULL THEN 'missing' WHEN m.passed IS NULL THEN 'no verdict (' || coalesce(m.missing_reason, 'no threshold') || ')'
  ELSE 'expected ' || CASE WHEN x.expected THEN 'PASS' ELSE 'FAIL' END || ', got ' || CASE WHEN m.passed THEN 'PASS' ELSE 'FAIL' END
    || ' (value=' || coalesce(CAST(round(m.value, 6) AS VARCHAR), CAST(m.value_bool AS VARCHAR)) || ')' END
FROM v_expected_metrics x LEFT JOIN v_metrics m ON m.file_id = x.case_id AND m.name = x.metric"""
VIEWS["v_truth"] = """
SELECT case_id, cls IN (1, 4) AS collision, CASE WHEN cls = 3 THEN NULL ELSE CASE WHEN cls IN (1, 4) THEN 556e-2 WHEN cls = 2 THEN 530e-2 ELSE 492e-2 END - 474e-2 END AS latency
FROM v_cases WHERE expected_quality <> 'blocked'"""
VIEWS["v_truth_checks"] = """
SELECT t.case_id, 'ground_truth:collision' AS name, coalesce(c.value_bool = t.collision, false) AS passed,
  'generator=' || CAST(t.collision AS VARCHAR) || ', metrics=' || coalesce(CAST(c.value_bool AS VARCHAR), 'none') AS detail
FROM v_truth t JOIN v_metrics c ON c.file_id = t.case_id AND c.name = 'collision'
UNION ALL SELECT t.case_id, 'ground_truth:braking_latency_s', coalesce(abs(l.value - t.latency) <= 5e-2, false),
  'generator=' || printf('%.3f', t.latency) || ', metrics=' || coalesce(CAST(l.value AS VARCHAR), 'none')
FROM v_truth t JOIN v_metrics l ON l.file_id = t.case_id AND l.name = 'braking_latency_s' WHERE t.latency IS NOT NULL"""

# --- evaluation of agent runs --------------------------------------------------------------------
VIEWS["v_ecases"] = """
SELECT run_id AS case_id, CASE WHEN c_custkey % 2 = 0 THEN ['perception_error', 'fusion_error'] ELSE ['planner_logic_error'] END AS acceptable,
  expected_outcome, max_report_confidence, quality_verdict, baseline_passed, latency_s, prompt_tokens, completion_tokens,
  CASE WHEN c_custkey % 97 = 0 THEN 'provider unavailable' END AS error, quality_verdict <> 'blocked' AND c_custkey % 97 <> 0 AS agent_ran FROM v_runs"""
VIEWS["v_aprof"] = """
SELECT run_id, arg_min(failure_class, rank) AS top_class, min(rank) FILTER (WHERE list_contains(acceptable, failure_class)) AS acceptable_rank,
  count(*) FILTER (WHERE failure_class <> 'unknown' AND label <> 'low') AS false_faults FROM v_kept JOIN (SELECT case_id, acceptable FROM v_ecases) c ON c.case_id = run_id GROUP BY run_id"""
_ORD = "(list_position(['blocked', 'low', 'medium', 'high'], {0}))"
VIEWS["v_agent_checks"] = f"""
SELECT c.case_id, 'top_hypothesis_class' AS name, coalesce(list_contains(c.acceptable, a.top_class), false) AS passed,
  CASE WHEN a.top_class IS NULL THEN 'no supported hypothesis survived verification' ELSE 'top=' || a.top_class || ', acceptable=' || array_to_string(list_sort(c.acceptable), ', ') || ', first acceptable at rank '
    || coalesce(CAST(acceptable_rank AS VARCHAR), 'none') END AS detail
FROM v_ecases c LEFT JOIN v_aprof a ON a.run_id = c.case_id WHERE agent_ran AND expected_outcome = 'fault'
UNION ALL SELECT c.case_id, 'no_false_fault', coalesce(false_faults, 0) = 0, CASE WHEN coalesce(false_faults, 0) = 0 THEN 'no fault hypothesis at or above medium'
  ELSE CAST(false_faults AS VARCHAR) || ' fault hypotheses on a nominal log' END
FROM v_ecases c LEFT JOIN v_aprof a ON a.run_id = c.case_id WHERE agent_ran AND expected_outcome = 'nominal'
UNION ALL SELECT c.case_id, 'confidence_cap', {_ORD.format('report_confidence')} <= {_ORD.format('c.max_report_confidence')}, 'report ' || report_confidence || ', cap ' || c.max_report_confidence
FROM v_ecases c JOIN v_verdicts d ON d.run_id = c.case_id WHERE agent_ran AND c.max_report_confidence IS NOT NULL"""
VIEWS["v_eresults"] = """
SELECT c.*, d.support, d.unsupported, d.human_review_required,
  CASE WHEN error IS NOT NULL THEN 'error' WHEN coalesce(ok, true) THEN 'pass' ELSE 'fail' END AS status
FROM v_ecases c JOIN v_verdicts d ON d.run_id = c.case_id LEFT JOIN (SELECT case_id, bool_and(passed) AS ok FROM v_agent_checks GROUP BY 1) k ON k.case_id = c.case_id"""
VIEWS["v_eagg"] = """
SELECT count(*) AS n_cases, count(*) FILTER (WHERE status = 'pass') AS n_passed, count(*) FILTER (WHERE status = 'fail') AS n_failed,
  count(*) FILTER (WHERE status = 'error') AS n_errors, count(*) FILTER (WHERE agent_ran) AS n_agent_cases,
  count(*) FILTER (WHERE t.passed IS NOT NULL) AS n_fault_cases_scored, count(*) FILTER (WHERE f.passed IS NOT NULL) AS n_nominal_cases_scored,
  count(*) FILTER (WHERE t.passed) * 1e0 / nullif(count(*) FILTER (WHERE t.passed IS NOT NULL), 0) AS top1_accuracy,
  count(*) FILTER (WHERE NOT f.passed) * 1e0 / nullif(count(*) FILTER (WHERE f.passed IS NOT NULL), 0) AS false_fault_rate,
  avg(support) FILTER (WHERE agent_ran) AS mean_evidence_support_rate, max(unsupported) FILTER (WHERE agent_ran) AS max_unsupported_claim_rate,
  CAST(sum(prompt_tokens) FILTER (WHERE agent_ran) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) FILTER (WHERE agent_ran) AS BIGINT) AS completion_tokens,
  count(*) FILTER (WHERE agent_ran AND human_review_required) AS n_human_review_required
FROM v_eresults r LEFT JOIN v_agent_checks t ON t.case_id = r.case_id AND t.name = 'top_hypothesis_class'
LEFT JOIN v_agent_checks f ON f.case_id = r.case_id AND f.name = 'no_false_fault'"""
VIEWS["v_tails"] = """
SELECT max(latency_s) FILTER (WHERE i = greatest(0, least(n - 1, round_even(5e-1 * (n - 1), 0)))) AS latency_p50_s,
  max(latency_s) FILTER (WHERE i = greatest(0, least(n - 1, round_even(95e-2 * (n - 1), 0)))) AS latency_p95_s
FROM (SELECT latency_s, row_number() OVER (ORDER BY latency_s) - 1 AS i, count(*) OVER () AS n FROM v_eresults WHERE agent_ran) x"""

# --- approvals -----------------------------------------------------------------------------------
VIEWS["v_decisions"] = """
SELECT concat('appr_', CAST(user_id AS VARCHAR(12))) AS approval_id, event_id, ts AS decided_at,
  CASE event_type WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'approved' ELSE 'deferred' END AS decision,
  concat('reviewer_', CAST(event_id % 5 AS VARCHAR)) AS reviewer, props AS reason,
  CASE WHEN event_type NOT IN ('error', 'purchase') THEN 'refused'
    WHEN row_number() OVER (PARTITION BY user_id, event_type IN ('error', 'purchase') ORDER BY ts, event_id) = 1 THEN 'applied' ELSE 'conflict' END AS outcome
FROM events"""
VIEWS["v_reports"] = f"""
SELECT {stable_id('report', 'run_id')} AS report_id, run_id, project_id, 'appr_' || CAST(c_custkey AS VARCHAR) AS approval_id, report_confidence, human_review_required FROM v_verdicts"""
