"""DuckDB views over agent hypotheses, citations, evidence and runs."""

from __future__ import annotations

from fleetgauge import vocab as v
from fleetgauge.plans.views import VIEWS, stable_id

VIEWS["v_hyp"] = """
SELECT concat('run_', lpad(CAST(o_custkey AS VARCHAR(12)), 12, '0')) AS run_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS hypothesis_index, o_orderkey AS hyp_key,
  concat('cause ', CAST(o_orderkey AS VARCHAR(12)), CASE WHEN o_orderkey % 29 = 0 THEN ' seen on-road' ELSE '' END) AS cause,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'perception_error' WHEN '2' THEN 'fusion_error' WHEN '3' THEN 'planner_logic_error'
       WHEN '4' THEN 'control_issue' ELSE 'unknown' END AS failure_class,
  CAST(o_orderkey * 37 % 101 AS DOUBLE) / 1e2 AS confidence
FROM orders"""
VIEWS["v_cite"] = """
SELECT l_orderkey AS hyp_key,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
  concat(CASE l_partkey % 6 WHEN 0 THEN 'metric_' WHEN 1 THEN 'event_' WHEN 2 THEN 'window_' WHEN 3 THEN 'chunk_' WHEN 4 THEN 'quality_' ELSE 'file_' END,
         lpad(CAST(l_partkey AS VARCHAR(12)), 12, '0')) AS evidence_id
FROM lineitem"""
VIEWS["v_evidence"] = """
SELECT concat(kind, '_', lpad(CAST(p_partkey AS VARCHAR(12)), 12, '0')) AS evidence_id, kind,
  CASE WHEN kind IN ('metric','event','window') THEN 'telemetry'
       WHEN kind = 'chunk' THEN CASE p_size % 3 WHEN 0 THEN 'doc:requirement' WHEN 1 THEN 'doc:issue' ELSE 'doc:dbc' END ELSE kind END AS source,
  p_name AS summary,
  CASE WHEN kind IN ('event','window') OR (kind = 'metric' AND p_size % 5 <> 0) THEN CAST(p_partkey % 100 AS DOUBLE) / 1e1 END AS t_s,
  CASE WHEN kind = 'metric' AND p_size % 7 <> 0 THEN p_size > 25 END AS passed,
  kind = 'chunk' AND p_size % 4 = 0 AS stale,
  kind = 'chunk' AND p_size % 11 = 0 AS injection_flagged
FROM (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'metric' WHEN 1 THEN 'event' WHEN 2 THEN 'window' WHEN 3 THEN 'chunk' WHEN 4 THEN 'quality' ELSE 'file' END AS kind
      FROM part WHERE p_partkey % 10 <> 0) x"""
VIEWS["v_runs"] = """
SELECT concat('run_', lpad(CAST(c_custkey AS VARCHAR(12)), 12, '0')) AS run_id, c_custkey,
  concat('proj_', CAST(c_nationkey AS VARCHAR(12))) AS project_id,
  CASE WHEN c_custkey % 10 = 0 THEN 'blocked' WHEN c_custkey % 10 IN (1, 2) THEN 'degraded' ELSE 'pass' END AS quality_verdict,
  CASE WHEN c_custkey % 2 = 0 THEN 'synthetic' ELSE 'unknown' END AS data_origin,
  CASE WHEN c_custkey % 13 = 0 THEN 'braking_latency_s: no brake command' END AS missing,
  CAST(c_custkey % 4 AS INT) AS excluded_by_access, CASE WHEN c_custkey % 7 = 0 THEN 'seen on-road by unit ' || CAST(c_custkey AS VARCHAR) END AS observed,
  concat('quality_', lpad(CAST(c_custkey AS VARCHAR(12)), 12, '0')) AS quality_id,
  CASE WHEN c_custkey % 10 = 0 THEN 'blocked' WHEN c_custkey % 3 = 0 THEN 'fault' ELSE 'nominal' END AS expected_outcome,
  CASE WHEN c_custkey % 10 IN (1, 2) THEN 'medium' END AS max_report_confidence,
  c_custkey % 5 <> 0 AS baseline_passed,
  abs(c_acctbal) / 1e2 AS latency_s, CAST(2000 + c_custkey % 700 AS INT) AS prompt_tokens, CAST(300 + c_custkey % 90 AS INT) AS completion_tokens
FROM customer"""

VIEWS["v_resolved"] = """
SELECT c.hyp_key, c.evidence_id, c.pos, e.kind, e.source, e.t_s, e.passed, e.stale, e.injection_flagged, e.evidence_id IS NOT NULL AS resolved
FROM (SELECT hyp_key, evidence_id, min(pos) AS pos FROM v_cite GROUP BY 1, 2) c LEFT JOIN v_evidence e ON c.evidence_id = e.evidence_id"""
VIEWS["v_hprof"] = """
SELECT hyp_key, count(*) AS cited, count(*) FILTER (WHERE resolved) AS resolved, count(*) FILTER (WHERE t_s IS NOT NULL) AS timed,
  count(*) FILTER (WHERE stale) AS stale, count(*) FILTER (WHERE injection_flagged) AS flagged,
  count(*) FILTER (WHERE kind = 'metric') AS metrics, count(*) FILTER (WHERE kind = 'metric' AND passed) AS passing,
  count(DISTINCT source) FILTER (WHERE source NOT IN ('file', 'quality')) AS n_sources
FROM v_resolved GROUP BY hyp_key"""
VIEWS["v_sources"] = """
SELECT hyp_key, string_agg(source, ', ' ORDER BY pos) AS sources FROM (
  SELECT hyp_key, source, min(pos) AS pos FROM v_resolved WHERE source NOT IN ('file', 'quality') GROUP BY 1, 2) x GROUP BY hyp_key"""
VIEWS["v_judged"] = """
SELECT h.*, coalesce(cited, 0) AS cited, coalesce(resolved, 0) AS resolved, coalesce(stale, 0) AS stale, coalesce(flagged, 0) AS flagged,
  coalesce(n_sources, 0) AS n_sources, coalesce(sources, '') AS sources, coalesce(metrics, 0) > 0 AND metrics = passing AS passing_only,
  CASE WHEN coalesce(cited, 0) = 0 THEN 'no evidence cited' WHEN resolved = 0 THEN 'none of the cited evidence IDs resolve'
       WHEN timed = 0 THEN 'no timestamped evidence for a root cause' END AS reason
FROM v_hyp h LEFT JOIN v_hprof p ON h.hyp_key = p.hyp_key LEFT JOIN v_sources s ON h.hyp_key = s.hyp_key"""
VIEWS["v_verified"] = """
SELECT *, n_sources <= 1 AS single_source,
  CASE WHEN reason IS NOT NULL THEN 'unsupported' WHEN cited > resolved THEN 'partial' ELSE 'supported' END AS status,
  CASE WHEN reason IS NULL THEN greatest(0e0, least(1e0, round(
    CASE WHEN n_sources <= 1 THEN least(confidence, 6e-1) ELSE confidence END - CASE WHEN stale > 0 THEN 1e-1 ELSE 0e0 END
    - CASE WHEN flagged > 0 THEN 2e-1 ELSE 0e0 END - CASE WHEN passing_only THEN 15e-2 ELSE 0e0 END, 4))) END AS adjusted
FROM v_judged"""
_BAND = "CASE WHEN {0} >= 7e-1 THEN 'high' WHEN {0} >= 4e-1 THEN 'medium' ELSE 'low' END"
VIEWS["v_kept"] = f"""
SELECT *, {_BAND.format('adjusted')} AS label, row_number() OVER (PARTITION BY run_id ORDER BY adjusted DESC, cause, hypothesis_index) AS rank
FROM v_verified WHERE reason IS NULL"""
_REAL = v.REAL_WORLD_PATTERN.replace("'", "''")
VIEWS["v_rprof"] = f"""
SELECT r.*, coalesce(n, 0) AS hypotheses, coalesce(k, 0) AS kept, coalesce(n, 0) - coalesce(k, 0) AS stripped, coalesce(cited_total, 0) AS cited_total,
  coalesce(cited_resolved, 0) AS cited_resolved, coalesce(flagged_hypotheses, 0) AS flagged_hypotheses, coalesce(classes, '') AS classes,
  coalesce(n_classes, 0) AS n_classes, top.cause AS top_cause, top.failure_class AS top_class, top.label AS top_label, top.adjusted AS top_adjusted,
  top.n_sources <= 1 AS top_single, coalesce(offender, observed) AS offender
FROM v_runs r LEFT JOIN (
  SELECT run_id, count(*) AS n, sum(cited) AS cited_total, sum(resolved) AS cited_resolved FROM v_verified GROUP BY 1) a ON r.run_id = a.run_id
LEFT JOIN (SELECT run_id, count(*) AS k, count(*) FILTER (WHERE flagged > 0) AS flagged_hypotheses,
  count(DISTINCT failure_class) FILTER (WHERE adjusted >= 6e-1) AS n_classes,
  arg_min(cause, rank) FILTER (WHERE regexp_matches(cause, '(?i){_REAL}')) AS offender FROM v_kept GROUP BY 1) b ON r.run_id = b.run_id
LEFT JOIN (SELECT run_id, string_agg(failure_class, ', ' ORDER BY failure_class) AS classes FROM (
  SELECT DISTINCT run_id, failure_class FROM v_kept WHERE adjusted >= 6e-1) x GROUP BY 1) c ON r.run_id = c.run_id
LEFT JOIN (SELECT * FROM v_kept WHERE rank = 1) top ON r.run_id = top.run_id"""
VIEWS["v_offenders"] = f"""
SELECT k.run_id, cause AS wording FROM v_kept k JOIN v_runs r ON r.run_id = k.run_id WHERE data_origin = 'synthetic' AND regexp_matches(cause, '(?i){_REAL}')
UNION SELECT run_id, observed FROM v_runs WHERE data_origin = 'synthetic' AND observed IS NOT NULL"""
VIEWS["v_levels"] = """
SELECT *, CASE WHEN flagged_hypotheses > 0 THEN least(l1, 2) ELSE l1 END AS level FROM (
  SELECT *, CASE WHEN missing IS NOT NULL THEN least(l0, 1) ELSE l0 END AS l1 FROM (
    SELECT *, CASE WHEN quality_verdict = 'blocked' THEN 0 WHEN kept = 0 THEN 1 ELSE
      least(CASE WHEN top_adjusted >= 7e-1 THEN 3 WHEN top_adjusted >= 4e-1 THEN 2 ELSE 1 END,
            CASE WHEN top_single OR quality_verdict = 'degraded' THEN 2 ELSE 3 END) END AS l0 FROM v_rprof) x) y"""
VIEWS["v_verdicts"] = f"""
SELECT *, {stable_id('verification', 'run_id')} AS verification_id, (['blocked', 'low', 'medium', 'high'])[level + 1] AS report_confidence,
  n_classes > 1 AS competing, flagged_hypotheses > 0 AS cites_flagged, data_origin = 'synthetic' AND offender IS NOT NULL AS real_world_wording,
  n_classes > 1 OR flagged_hypotheses > 0 OR (data_origin = 'synthetic' AND offender IS NOT NULL) AS human_review_required,
  CASE WHEN cited_total > 0 THEN cited_resolved * 1e0 / cited_total ELSE 1e0 END AS support,
  CASE WHEN hypotheses > 0 THEN stripped * 1e0 / hypotheses ELSE 0e0 END AS unsupported
FROM v_levels"""
