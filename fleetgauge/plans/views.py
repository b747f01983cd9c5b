"""DuckDB views for the SQL side of the checks.

Each entry is one view in plain SQL over the driver tables or over other entries; ``compose``
prefixes a query with the views it needs. They restate the semantics independently of the Spark
operators: single windows per log, no segments, no histograms.
"""

from __future__ import annotations

import hashlib
import re

from fleetgauge.policies import AebThresholds, QualityPolicy

VIEWS: dict[str, str] = {}


def compose(sql: str) -> str:
    """``WITH`` clause with every view the query mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str, open_views: tuple[str, ...]) -> None:
        for name in sorted(set(re.findall(r"\bv_[a-z0-9_]+\b", text))):
            if name in VIEWS and name not in needed and name not in open_views:
                visit(VIEWS[name], (*open_views, name))
                needed.append(name)

    visit(sql, ())
    if not needed:
        return sql
    # each view is computed once; a view that reads itself is recursive and stays as it is
    how = {n: "AS" if re.search(rf"\b{n}\b", VIEWS[n]) else "AS MATERIALIZED" for n in needed}
    return "WITH RECURSIVE " + ",\n".join(f"{n} {how[n]} (\n{VIEWS[n]}\n)" for n in needed) + "\n" + sql


def stable_id(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256({' || chr(31) || '.join(parts)}), 1, 12)"


SCOPE_DIGEST = hashlib.sha256(AebThresholds().to_json().encode()).hexdigest()[:8]
SCOPE = f"(file_id || ':{SCOPE_DIGEST}')"
POLICY_JSON = "'" + QualityPolicy().to_json() + "'"

# --- telemetry -------------------------------------------------------------------------------

VIEWS["v_tel"] = """
WITH base AS (
  SELECT l_suppkey AS k, l_discount, l_tax,
         CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS BIGINT) AS r
  FROM lineitem),
p AS (
  SELECT k, r, l_discount, l_tax, CAST(k % 12 AS INT) AS cls,
         r * 2e-2 AS t,
         CASE WHEN k % 12 IN (1,4) THEN 556e-2 WHEN k % 12 = 2 THEN 530e-2 ELSE 492e-2 END AS tb
  FROM base),
q AS (
  SELECT *, 30e0 - 3e0*(tb-3e0)*(tb-3e0) AS gb, 6e0*(tb-3e0) AS vb,
         least(greatest(t - tb, 0e0), 6e0*(tb-3e0)/8e0) AS y
  FROM p),
s AS (
SELECT concat('file_', lpad(CAST(k AS VARCHAR(12)), 12, '0')) AS file_id, cls, r AS src_row,
  CASE WHEN cls = 8 AND r = 200 THEN 199*2e-2 ELSE t END AS t,
  (CASE WHEN cls = 9 THEN 36e0 ELSE 1e0 END) *
    greatest(0e0, 13.889e0 - 9e0*greatest(t-tb, 0e0) + (l_discount-5e-2)) AS speed,
  CASE WHEN cls = 10 THEN NULL
       WHEN t < tb OR 9e0*(t-tb) > 13.889e0 THEN (l_tax-4e-2)
       ELSE -least(9e0, 25e0*(t-tb)) + (l_tax-4e-2) END AS accel,
  CASE WHEN cls = 5 AND r BETWEEN 100 AND 159 THEN NULL
       ELSE greatest(0e0, CASE WHEN t < 3e0 THEN 30e0
                               WHEN t < tb THEN 30e0 - 3e0*(t-3e0)*(t-3e0)
                               ELSE gb - vb*y + 4e0*y*y END + (l_tax-4e-2)) END AS gap,
  CASE WHEN t < 3e0 THEN 0e0 WHEN t < tb THEN -6e0*(t-3e0) ELSE least(0e0, -vb + 8e0*y) END
    + (l_discount-5e-2) AS rel_v,
  CASE WHEN cls = 11 THEN NULL
       WHEN cls = 4 AND r BETWEEN 50 AND 69 THEN NULL
       WHEN cls IN (1,2,4) AND t >= 42e-1 AND t < tb - 16e-2 THEN 22e-2 + (l_tax-4e-2)
       ELSE 92e-2 + (l_tax-4e-2) END AS conf,
  CASE WHEN cls = 3 THEN 0 WHEN t >= tb THEN 1 ELSE 0 END AS brake,
  CASE WHEN cls <> 3 AND t >= tb THEN 2 WHEN t >= 42e-1 THEN 1 ELSE 0 END AS state
FROM q
WHERE NOT (cls = 6 AND r BETWEEN 50 AND 64) AND NOT (cls = 7 AND r BETWEEN 100 AND 299))
SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY src_row) - 1 AS BIGINT) AS row FROM s"""

VIEWS["v_files"] = """
SELECT DISTINCT concat('file_', lpad(CAST(l_suppkey AS VARCHAR(12)), 12, '0')) AS file_id,
  concat('logs/', lpad(CAST(l_suppkey AS VARCHAR(12)), 12, '0'), '.csv') AS source_path,
  CASE WHEN l_suppkey % 2 = 0 THEN 'synthetic' ELSE 'unknown' END AS data_origin,
  CAST(l_suppkey % 12 AS INT) AS cls FROM lineitem"""

VIEWS["v_intervals"] = """
SELECT file_id, row, start_s, t AS end_s, t - start_s AS dt FROM (
  SELECT file_id, row, t, lag(t) OVER (PARTITION BY file_id ORDER BY row) AS start_s FROM v_tel) x
WHERE start_s IS NOT NULL"""

VIEWS["v_nominal"] = "SELECT file_id, median(dt) AS nominal FROM v_intervals GROUP BY file_id"

VIEWS["v_iprof"] = """
SELECT i.file_id, max(nominal) AS nominal, count(*) FILTER (WHERE dt <= 0) AS non_increasing,
  count(*) FILTER (WHERE dt > 2.5e0 * nominal) AS gaps,
  coalesce(sum(dt - nominal) FILTER (WHERE dt > 2.5e0 * nominal), 0e0) AS missing_s
FROM v_intervals i JOIN v_nominal n ON i.file_id = n.file_id GROUP BY i.file_id"""

VIEWS["v_prof"] = """
SELECT t.file_id, any_value(t.cls) AS cls, count(*) AS n_rows, max(t) - min(t) AS extent_s,
  count(*) FILTER (WHERE speed IS NULL) AS null_speed, count(*) FILTER (WHERE gap IS NULL) AS null_gap,
  count(*) FILTER (WHERE rel_v IS NULL) AS null_rel_v, count(*) FILTER (WHERE conf IS NULL) AS null_conf,
  count(*) FILTER (WHERE accel IS NULL) AS null_accel,
  count(*) FILTER (WHERE speed < 0) AS bad_speed, count(*) FILTER (WHERE gap < 0) AS bad_gap,
  count(*) FILTER (WHERE conf < 0 OR conf > 1) AS bad_conf,
  count(*) FILTER (WHERE brake NOT IN (0, 1)) AS bad_brake,
  coalesce(max(abs(speed)), 0e0) AS peak_speed, coalesce(max(abs(rel_v)), 0e0) AS peak_rel_v,
  coalesce(max(abs(gap)), 0e0) AS peak_gap, coalesce(max(abs(accel)), 0e0) AS peak_accel,
  count(*) FILTER (WHERE brake = 1) AS brake_samples, count(*) FILTER (WHERE rel_v < -5e-1) AS closing_samples,
  any_value(nominal) AS nominal, any_value(non_increasing) AS non_increasing, any_value(gaps) AS gaps,
  any_value(missing_s) AS missing_s
FROM v_tel t JOIN v_iprof i ON t.file_id = i.file_id GROUP BY t.file_id"""

VIEWS["v_nulls"] = """
SELECT file_id, s.signal AS signal, s.pos AS pos, s.critical AS critical, s.n AS n, s.n * 1e0 / n_rows AS fraction
FROM (SELECT file_id, n_rows, unnest([
  {'pos': 1, 'signal': 'ego_speed_mps', 'critical': true, 'n': null_speed},
  {'pos': 2, 'signal': 'relative_distance_m', 'critical': true, 'n': null_gap},
  {'pos': 3, 'signal': 'relative_velocity_mps', 'critical': true, 'n': null_rel_v},
  {'pos': 4, 'signal': 'object_confidence', 'critical': true, 'n': CASE WHEN cls = 11 THEN 0 ELSE null_conf END},
  {'pos': 5, 'signal': 'ego_acceleration_mps2', 'critical': false, 'n': CASE WHEN cls = 10 THEN 0 ELSE null_accel END}
  ]) AS s FROM v_prof) x WHERE s.n > 0"""

VIEWS["v_gates"] = """
SELECT file_id, 0 AS gate_index, 'required_signals' AS gate,
  CASE cls WHEN 11 THEN 'fail' WHEN 10 THEN 'warn' ELSE 'pass' END AS status,
  CASE cls WHEN 11 THEN 'critical signals missing: object_confidence'
           WHEN 10 THEN 'optional signals missing: ego_acceleration_mps2' ELSE 'all signals present' END AS message
FROM v_prof
UNION ALL
SELECT file_id, 1, 'size', CASE WHEN n_rows < 20 OR (n_rows >= 2 AND extent_s < 2e0) THEN 'fail' ELSE 'pass' END,
  CASE WHEN n_rows < 20 THEN CAST(n_rows AS VARCHAR) || ' rows < minimum 20'
       WHEN extent_s < 2e0 THEN 'duration ' || printf('%.2f', extent_s) || ' s < minimum 2.0 s'
       ELSE CAST(n_rows AS VARCHAR) || ' rows, ' || CAST(extent_s AS VARCHAR) || ' s' END
FROM v_prof
UNION ALL
SELECT file_id, 2, 'timestamp_continuity',
  CASE WHEN n_rows < 2 OR non_increasing > 0 OR missing_s / extent_s > 1e-1 THEN 'fail'
       WHEN gaps > 0 THEN 'warn' ELSE 'pass' END,
  CASE WHEN n_rows < 2 THEN 'fewer than two samples'
       WHEN non_increasing > 0 THEN CAST(non_increasing AS VARCHAR) || ' non-increasing timestamps (duplicates or reordering)'
       WHEN missing_s / extent_s > 1e-1 THEN CAST(gaps AS VARCHAR) || ' gap(s) covering ' || printf('%.2f', missing_s)
            || ' s (' || printf('%.0f', missing_s / extent_s * 100e0) || '% of log) exceed 10%'
       WHEN gaps > 0 THEN CAST(gaps AS VARCHAR) || ' timestamp gap(s) totalling ' || printf('%.2f', missing_s) || ' s'
       ELSE 'continuous at ' || printf('%.1f', 1e0 / nominal) || ' Hz' END
FROM v_prof
UNION ALL
SELECT p.file_id, 3, 'missing_values',
  CASE WHEN coalesce(worst, 0) > 5e-2 THEN 'fail' WHEN every IS NOT NULL THEN 'warn' ELSE 'pass' END,
  CASE WHEN coalesce(worst, 0) > 5e-2 THEN 'critical signal(s) ' || critical || ' missing '
            || printf('%.1f', worst * 100e0) || '% of samples (> 5%)'
       WHEN every IS NOT NULL THEN 'missing values in: ' || every ELSE 'no missing values' END
FROM v_prof p LEFT JOIN (
  SELECT file_id, max(fraction) FILTER (WHERE critical) AS worst, string_agg(signal, ', ' ORDER BY pos) AS every,
         string_agg(signal, ', ' ORDER BY pos) FILTER (WHERE critical) AS critical
  FROM v_nulls GROUP BY file_id) n ON p.file_id = n.file_id
UNION ALL
SELECT file_id, 4, 'value_ranges', CASE WHEN found = '' THEN 'pass' ELSE 'fail' END,
  CASE WHEN found = '' THEN 'all values in range' ELSE 'out-of-range values: ' || found END
FROM (SELECT file_id, concat_ws(', ',
  CASE WHEN bad_speed > 0 THEN 'ego_speed_mps (' || CAST(bad_speed AS VARCHAR) || ')' END,
  CASE WHEN bad_gap > 0 THEN 'relative_distance_m (' || CAST(bad_gap AS VARCHAR) || ')' END,
  CASE WHEN bad_conf > 0 THEN 'object_confidence (' || CAST(bad_conf AS VARCHAR) || ')' END,
  CASE WHEN bad_brake > 0 THEN 'brake_command (' || CAST(bad_brake AS VARCHAR) || ')' END) AS found FROM v_prof) r
UNION ALL
SELECT file_id, 5, 'unit_plausibility', CASE WHEN hard <> '' THEN 'fail' WHEN soft <> '' THEN 'warn' ELSE 'pass' END,
  CASE WHEN hard <> '' THEN 'implausible magnitudes, check units: ' || hard WHEN soft <> '' THEN soft
       ELSE 'magnitudes plausible for SI' END
FROM (SELECT file_id, concat_ws('; ',
    CASE WHEN peak_speed > 90e0 THEN 'ego_speed_mps peaks at ' || printf('%.1f', peak_speed) || ' (ceiling 90.0)' END,
    CASE WHEN peak_rel_v > 90e0 THEN 'relative_velocity_mps peaks at ' || printf('%.1f', peak_rel_v) || ' (ceiling 90.0)' END) AS hard,
  concat_ws('; ',
    CASE WHEN peak_gap > 500e0 THEN 'relative_distance_m peaks at ' || printf('%.1f', peak_gap) || ' (ceiling 500.0)' END,
    CASE WHEN peak_accel > 20e0 THEN 'ego_acceleration_mps2 peaks at ' || printf('%.1f', peak_accel) || ' (ceiling 20.0)' END) AS soft
  FROM v_prof) u
UNION ALL
SELECT file_id, 6, 'scenario_completeness', CASE WHEN brake_samples = 0 OR closing_samples = 0 THEN 'warn' ELSE 'pass' END,
  CASE WHEN brake_samples = 0 OR closing_samples = 0 THEN concat_ws('; ',
    CASE WHEN brake_samples = 0 THEN 'no brake command in log; braking-latency metrics unavailable' END,
    CASE WHEN closing_samples = 0 THEN 'ego never closes on the lead; no TTC-relevant episode' END)
  ELSE 'brake event and closing phase present' END
FROM v_prof"""

VIEWS["v_quality"] = f"""
SELECT file_id, {stable_id('quality', 'file_id', POLICY_JSON)} AS quality_id,
  CASE WHEN bool_or(status = 'fail') THEN 'blocked' WHEN bool_or(status = 'warn') THEN 'degraded' ELSE 'pass' END AS verdict,
  string_agg(gate || '=' || status, '; ' ORDER BY gate_index) AS gate_summary,
  coalesce(string_agg(gate || ': ' || message, '; ' ORDER BY gate_index) FILTER (WHERE status = 'fail'), '') AS failures,
  coalesce(string_agg(gate || ': ' || message, '; ' ORDER BY gate_index) FILTER (WHERE status = 'warn'), '') AS warnings,
  coalesce(string_agg(gate, ', ' ORDER BY gate_index) FILTER (WHERE status = 'warn'), '') AS warned_gates
FROM v_gates GROUP BY file_id"""

VIEWS["v_ttc"] = """
SELECT *, CASE WHEN -rel_v > 5e-1 THEN gap / (-rel_v) END AS ttc FROM v_tel"""

VIEWS["v_eprof"] = """
SELECT file_id, min(row) FILTER (WHERE brake = 1) AS brake_row, arg_min(t, row) FILTER (WHERE brake = 1) AS brake_t,
  min(row) FILTER (WHERE ttc <= 2e0) AS crossing_row, arg_min(t, row) FILTER (WHERE ttc <= 2e0) AS crossing_t,
  min(row) FILTER (WHERE gap <= 1e-1) AS collision_row, arg_min(t, row) FILTER (WHERE gap <= 1e-1) AS collision_t,
  arg_min(t, row) AS first_t, arg_max(t, row) AS last_t
FROM v_ttc GROUP BY file_id"""

VIEWS["v_events"] = f"""
SELECT file_id, event_type, t_s, row, description, first_t, last_t,
  {stable_id('event', SCOPE, 'event_type')} AS event_id
FROM (
  SELECT file_id, 'aeb_brake_command' AS event_type, brake_t AS t_s, brake_row AS row,
    'first sample with brake_command == 1' AS description, first_t, last_t FROM v_eprof
  UNION ALL SELECT file_id, 'ttc_threshold_crossing', crossing_t, crossing_row, 'first sample with TTC <= 2.0 s', first_t, last_t FROM v_eprof
  UNION ALL SELECT file_id, 'collision', collision_t, collision_row, 'first sample with relative_distance <= 0.1 m', first_t, last_t FROM v_eprof
) e WHERE row IS NOT NULL"""

VIEWS["v_aevents"] = """
SELECT e.* FROM v_events e JOIN v_quality q ON e.file_id = q.file_id WHERE q.verdict <> 'blocked'"""

VIEWS["v_windows"] = f"""
SELECT file_id, {stable_id('window', SCOPE, 'event_id')} AS window_id, event_id, event_type, t_s AS t_event_s,
  start_s, end_s, start_row, end_row, end_row - start_row + 1 AS sample_count,
  t_s - 5e0 < first_t - 1e-9 AS clipped_start, t_s + 5e0 > last_t + 1e-9 AS clipped_end
FROM (
  SELECT e.file_id, e.event_id, e.event_type, any_value(e.t_s) AS t_s, any_value(e.first_t) AS first_t,
    any_value(e.last_t) AS last_t, min(s.row) AS start_row, max(s.row) AS end_row, min(s.t) AS start_s, max(s.t) AS end_s
  FROM v_aevents e JOIN v_tel s ON e.file_id = s.file_id AND s.t BETWEEN e.t_s - 5e0 AND e.t_s + 5e0
  GROUP BY e.file_id, e.event_id, e.event_type) w"""

VIEWS["v_scope"] = """
SELECT p.file_id, q.quality_id, coalesce(brake_t, crossing_t) AS anchor_t,
  CASE WHEN brake_row IS NOT NULL THEN 'aeb_brake_command' WHEN crossing_row IS NOT NULL THEN 'ttc_threshold_crossing' END AS anchor_type,
  brake_t, brake_row,
  CASE WHEN brake_row IS NULL OR crossing_t BETWEEN brake_t - 5e0 AND brake_t + 5e0 THEN crossing_t END AS crossing_t,
  CASE WHEN coalesce(brake_t, crossing_t) IS NULL
         OR collision_t BETWEEN coalesce(brake_t, crossing_t) - 5e0 AND coalesce(brake_t, crossing_t) + 5e0 THEN collision_t END AS collision_t
FROM v_eprof p JOIN v_quality q ON p.file_id = q.file_id WHERE q.verdict <> 'blocked'"""

VIEWS["v_primary"] = """
SELECT s.*, w.window_id, w.clipped_start, w.clipped_end FROM v_scope s
LEFT JOIN v_windows w ON s.file_id = w.file_id AND s.anchor_type = w.event_type"""

VIEWS["v_slices"] = """
SELECT t.*, s.brake_t, s.brake_row, s.crossing_t FROM v_ttc t JOIN v_scope s ON t.file_id = s.file_id
WHERE s.anchor_t IS NULL OR t.t BETWEEN s.anchor_t - 5e0 AND s.anchor_t + 5e0"""


def _gradient(y: str) -> str:
    y0, y1 = f"lag({y}) OVER w", f"lead({y}) OVER w"
    return (
        f"CASE WHEN lag(t) OVER w IS NULL AND lead(t) OVER w IS NULL THEN NULL "
        f"WHEN lag(t) OVER w IS NULL THEN ({y1} - {y}) / (lead(t) OVER w - t) "
        f"WHEN lead(t) OVER w IS NULL THEN ({y} - {y0}) / (t - lag(t) OVER w) "
        f"ELSE ((t - lag(t) OVER w) * (t - lag(t) OVER w) * ({y1}) "
        f"+ ((lead(t) OVER w - t) * (lead(t) OVER w - t) - (t - lag(t) OVER w) * (t - lag(t) OVER w)) * {y} "
        f"- (lead(t) OVER w - t) * (lead(t) OVER w - t) * ({y0})) "
        f"/ ((t - lag(t) OVER w) * (lead(t) OVER w - t) * ((lead(t) OVER w - t) + (t - lag(t) OVER w))) END"
    )


_W = "WINDOW w AS (PARTITION BY file_id ORDER BY row)"
_SMOOTH = "avg({0}) OVER (PARTITION BY file_id ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
VIEWS["v_d1"] = f"""
SELECT *, t - lag(t) OVER w AS dt, {_SMOOTH.format('accel')} AS a_s, {_SMOOTH.format('speed')} AS v_s FROM v_slices {_W}"""
VIEWS["v_d2"] = f"SELECT *, {_gradient('a_s')} AS jerk, {_gradient('v_s')} AS a_f FROM v_d1 {_W}"
VIEWS["v_d3"] = f"SELECT *, {_SMOOTH.format('a_f')} AS af_s FROM v_d2"
VIEWS["v_derived"] = f"SELECT *, {_gradient('af_s')} AS jerk_f FROM v_d3 {_W}"

_RISK = ("crossing_t IS NOT NULL AND t >= crossing_t - 1e-9 AND (brake_t IS NULL OR t <= brake_t + 1e-9)")
VIEWS["v_measures"] = f"""
SELECT file_id, min(ttc) AS min_ttc, min(gap) AS min_gap, min(accel) AS min_accel, min(a_f) AS min_a_f,
  max(abs(jerk)) FILTER (WHERE speed > 5e-1) AS max_jerk, max(abs(jerk_f)) FILTER (WHERE speed > 5e-1) AS max_jerk_f,
  min(conf) FILTER (WHERE {_RISK}) AS min_conf, max(speed) FILTER (WHERE row = brake_row) AS speed_at_brake,
  min(t) FILTER (WHERE conf >= 5e-1) AS first_detection_t, count(*) FILTER (WHERE {_RISK}) AS risk_rows,
  count(*) FILTER (WHERE {_RISK} AND conf < 5e-1) AS below_rows, min(t) FILTER (WHERE {_RISK} AND conf < 5e-1) AS first_below_t,
  median(dt) AS window_dt
FROM v_derived GROUP BY file_id"""


VIEWS["v_metric_base"] = f"""
SELECT s.file_id, s.window_id, s.quality_id, s.brake_t, s.crossing_t, s.collision_t, f.cls, m.* EXCLUDE (file_id),
  tt.t AS min_ttc_t, tg.t AS min_gap_t, ta.t AS min_accel_t, tf.t AS min_a_f_t, tj.t AS max_jerk_t, tjf.t AS max_jerk_f_t, tc.t AS min_conf_t
FROM v_primary s JOIN v_files f ON s.file_id = f.file_id LEFT JOIN v_measures m ON s.file_id = m.file_id
LEFT JOIN (SELECT d.file_id, min(d.t) AS t FROM v_derived d JOIN v_measures x ON d.file_id = x.file_id AND d.ttc = x.min_ttc GROUP BY 1) tt ON tt.file_id = s.file_id
LEFT JOIN (SELECT d.file_id, min(d.t) AS t FROM v_derived d JOIN v_measures x ON d.file_id = x.file_id AND d.gap = x.min_gap GROUP BY 1) tg ON tg.file_id = s.file_id
LEFT JOIN (SELECT d.file_id, min(d.t) AS t FROM v_derived d JOIN v_measures x ON d.file_id = x.file_id AND d.accel = x.min_accel GROUP BY 1) ta ON ta.file_id = s.file_id
LEFT JOIN (SELECT d.file_id, min(d.t) AS t FROM v_derived d JOIN v_measures x ON d.file_id = x.file_id AND d.a_f = x.min_a_f GROUP BY 1) tf ON tf.file_id = s.file_id
LEFT JOIN (SELECT d.file_id, min(d.t) AS t FROM v_derived d JOIN v_measures x ON d.file_id = x.file_id AND abs(d.jerk) = x.max_jerk AND speed > 5e-1 GROUP BY 1) tj ON tj.file_id = s.file_id
LEFT JOIN (SELECT d.file_id, min(d.t) AS t FROM v_derived d JOIN v_measures x ON d.file_id = x.file_id AND abs(d.jerk_f) = x.max_jerk_f AND speed > 5e-1 GROUP BY 1) tjf ON tjf.file_id = s.file_id
LEFT JOIN (SELECT d.file_id, min(d.t) AS t FROM v_derived d JOIN v_measures x ON d.file_id = x.file_id AND d.conf = x.min_conf AND {_RISK} GROUP BY 1) tc ON tc.file_id = s.file_id"""

_ACC = ("CASE WHEN min_accel IS NOT NULL THEN 'logged ego_acceleration' WHEN min_a_f IS NOT NULL THEN "
        "'d(ego_speed)/dt with 5-sample centred moving average (acceleration signal not logged)' END")
_AT_RISK = "(crossing_t IS NOT NULL AND risk_rows > 0)"


def _metric(index, name, value, unit, t_s, limit, op, method, reason, emit="true", flag="CAST(NULL AS BOOLEAN)"):
    found = f"({value} IS NOT NULL)" if "NULL AS BOOLEAN" in flag else f"({flag} IS NOT NULL)"
    left = value if "NULL AS BOOLEAN" in flag else flag
    sql_op = {"==": "=", "<=": "<=", ">=": ">=", None: None}[op]
    passed = f"({left}) {sql_op} {limit}" if op else "CAST(NULL AS BOOLEAN)"
    is_flag = limit in ("true", "false")
    thr = f"CASE WHEN {found} THEN CAST({limit} AS DOUBLE) END" if op and not is_flag else "CAST(NULL AS DOUBLE)"
    thr_b = f"CASE WHEN {found} THEN {limit} END" if is_flag else "CAST(NULL AS BOOLEAN)"
    comp = f"CASE WHEN {found} THEN '{op}' END" if op else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT file_id, window_id, quality_id, {index} AS metric_index, '{name}' AS name, CAST({value} AS DOUBLE) AS value, {flag} AS value_bool, "
        f"'{unit}' AS unit, CASE WHEN {found} THEN {t_s} END AS t_s, {thr} AS threshold, {thr_b} AS threshold_bool, "
        f"{comp} AS comparator, {passed} AS passed, {method} AS method, "
        f"CASE WHEN NOT {found} THEN {reason} END AS missing_reason FROM v_metric_base WHERE {emit}"
    )


_NULL = "CAST(NULL AS VARCHAR)"
_DECEL = "(CASE WHEN min_accel IS NOT NULL THEN -min_accel ELSE -min_a_f END)"
_DECEL_T = "(CASE WHEN min_accel IS NOT NULL THEN min_accel_t ELSE min_a_f_t END)"
_JERK = "(CASE WHEN min_accel IS NOT NULL THEN max_jerk ELSE max_jerk_f END)"
_JERK_T = "(CASE WHEN min_accel IS NOT NULL THEN max_jerk_t ELSE max_jerk_f_t END)"
_TTC_METHOD = "'relative_distance / (-relative_velocity) per sample, undefined when closing speed <= 0.5 m/s'"
VIEWS["v_metric_rows"] = "\nUNION ALL ".join([
    _metric(0, "min_ttc_s", "min_ttc", "s", "min_ttc_t", "5e-1", ">=", _TTC_METHOD, "'ego never closes on the lead'"),
    _metric(1, "ttc_threshold_crossing_s", "crossing_t", "s", "crossing_t", None, None, "'first sample with TTC <= 2.0 s'", "'TTC never fell to 2.0 s'"),
    _metric(2, "brake_command_time_s", "brake_t", "s", "brake_t", None, None,
            "CASE WHEN brake_t IS NULL THEN 'brake_command rising edge' ELSE 'first sample with brake_command == 1' END", "'brake_command never asserted'"),
    _metric(3, "braking_latency_s", "round(brake_t - crossing_t, 6)", "s", "brake_t", "3e-1", "<=", "'brake_command_time_s - ttc_threshold_crossing_s'",
            "CASE WHEN brake_t IS NULL THEN 'no brake command' ELSE 'no TTC threshold crossing' END"),
    _metric(4, "ego_speed_at_brake_command_mps", "speed_at_brake", "m/s", "brake_t", None, None, "'ego_speed at brake command sample'", _NULL, "speed_at_brake IS NOT NULL"),
    _metric(5, "min_relative_distance_m", "min_gap", "m", "min_gap_t", None, None, "'min relative_distance'", "'no distance samples'"),
    _metric(6, "collision", "CAST(NULL AS DOUBLE)", "bool", "collision_t", "false", "==", "'any sample with relative_distance <= 0.1 m'", _NULL,
            flag="(collision_t IS NOT NULL)"),
    _metric(7, "collision_time_s", "collision_t", "s", "collision_t", None, None, "'first collision sample'", _NULL, "collision_t IS NOT NULL"),
    _metric(8, "max_deceleration_mps2", _DECEL, "m/s^2", _DECEL_T, "10e0", "<=", f"coalesce('max(-a) from ' || {_ACC}, 'n/a')", "'no acceleration or speed'"),
    _metric(9, "max_abs_jerk_mps3", _JERK, "m/s^3", _JERK_T, "30e0", "<=",
            f"coalesce('max |d(a)/dt| with 5-sample centred moving average on ' || {_ACC} || ', while ego_speed > 0.5 m/s', 'n/a')",
            f"CASE WHEN {_DECEL} IS NULL THEN 'no acceleration or speed' ELSE 'ego never moving' END"),
    _metric(10, "first_detection_time_s", "first_detection_t", "s", "first_detection_t", None, None,
            "CASE WHEN cls = 11 THEN 'confidence >= threshold' ELSE 'first sample with object_confidence >= 0.5' END", "'object_confidence never reached 0.5'"),
    _metric(11, "confidence_dropout_during_risk_s", f"CASE WHEN {_AT_RISK} THEN round(below_rows * window_dt, 6) END", "s", "first_below_t", "0e0", "<=",
            f"CASE WHEN {_AT_RISK} THEN 'samples with object_confidence < 0.5 between TTC crossing and brake command, times nominal dt' ELSE 'confidence < threshold' END",
            "'no TTC threshold crossing'", f"{_AT_RISK} OR crossing_t IS NULL"),
    _metric(12, "min_confidence_during_risk", "min_conf", "ratio", "min_conf_t", "5e-1", ">=", "'min object_confidence between TTC crossing and brake command'",
            "'no confidence samples in the risk phase'", _AT_RISK),
])
VIEWS["v_metrics"] = f"SELECT *, {stable_id('metric', SCOPE, 'name')} AS metric_id FROM v_metric_rows"
