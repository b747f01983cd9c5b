"""Ingest-side expressions, quality gates, events, windows and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions import ids, kinematics as kin
from fleetgauge.operators import events as ev
from fleetgauge.operators import faults, gates, metrics, segments
from fleetgauge.plans import fixtures as fx
from fleetgauge.plans.registry import r6, register, rounded
from fleetgauge.plans.views import SCOPE, stable_id
from fleetgauge.session import shared_folder, stored
from fleetgauge.policies import AebThresholds, QualityPolicy


def _profile(spark, sf_dir, policy=QualityPolicy()):
    return gates.quality_profile(fx.telemetry(spark, sf_dir), fx.provenance(spark, sf_dir), policy)


def _analysis(spark, sf_dir, thresholds=AebThresholds()):
    tel, files = fx.telemetry(spark, sf_dir), fx.provenance(spark, sf_dir)
    profile = stored(metrics.log_profile(tel, files, thresholds), "profile")
    return metrics.Analysis(tel, files, profile, thresholds)


def stored_analysis(spark, sf_dir, thresholds=AebThresholds()):
    """The same with stored windows and metrics, for results that combine several parts."""
    a = _analysis(spark, sf_dir, thresholds)
    a.windows, a.metrics = stored(a.windows, "windows"), stored(a.metrics, "metrics")
    return a


# --- expressions -----------------------------------------------------------------------------


@register("ttc_series", "SELECT file_id, row, round(ttc, 6) AS ttc_s FROM v_ttc")
def ttc_series(spark, sf_dir):
    return ev.ttc_series(fx.telemetry(spark, sf_dir)).select("file_id", "row", r6("ttc_s").alias("ttc_s"))


@register("stable_id", f"""
SELECT o_orderkey, {stable_id('run', 'CAST(o_custkey AS VARCHAR)', 'o_orderpriority', 'CAST(o_orderkey AS VARCHAR)')} AS run_id
FROM orders""")
def stable_id_query(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", ids.stable_id(
        "run", F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderkey")).alias("run_id"))


@register("evidence_scope", f"SELECT file_id, {SCOPE} AS scope FROM v_files")
def evidence_scope(spark, sf_dir):
    return fx.provenance(spark, sf_dir).select(
        "file_id", ids.evidence_scope(F.col("file_id"), AebThresholds()).alias("scope"))


@register("threshold_verdict", """
SELECT file_id, row, speed <= 13e0 AS le_passed, gap >= 5e0 AS ge_passed, brake = 0 AS eq_passed,
  CAST(NULL AS BOOLEAN) AS no_threshold FROM v_tel""")
def threshold_verdict(spark, sf_dir):
    return fx.telemetry(spark, sf_dir).select(
        "file_id", "row",
        F.expr(kin.threshold_verdict(v.SPEED, "<=", "13D")).alias("le_passed"),
        F.expr(kin.threshold_verdict(v.GAP, ">=", "5D")).alias("ge_passed"),
        F.expr(kin.threshold_verdict(v.BRAKE, "==", "0D")).alias("eq_passed"),
        F.expr(kin.threshold_verdict(v.SPEED, None, None)).alias("no_threshold"))


@register("format_value", """
SELECT file_id, metric_index, CASE WHEN value_bool THEN 'yes' WHEN NOT value_bool THEN 'no' WHEN value IS NULL THEN '—'
  ELSE printf('%.3f', value) END AS observed FROM v_metrics""")
def format_value(spark, sf_dir):
    return _analysis(spark, sf_dir).metrics.select(
        "file_id", "metric_index", F.expr(kin.format_value("value", "value_bool")).alias("observed"))


@register("telemetry_export", """
SELECT file_id, row, t AS timestamp_s, round(speed * 3.6e0, 6) AS ego_speed_kmh, round(rel_v * 3.6e0, 6) AS relative_velocity_kmh,
  round(gap, 6) AS relative_distance_m FROM v_tel""")
def telemetry_export(spark, sf_dir):
    from fleetgauge.sources.telemetry import to_export

    return rounded(
        to_export(fx.telemetry(spark, sf_dir)).select(
            "file_id", "row", v.TIMESTAMP, "ego_speed_kmh", "relative_velocity_kmh", v.GAP),
        "ego_speed_kmh", "relative_velocity_kmh", v.GAP)


# --- faults -----------------------------------------------------------------------------------


@register("fault_timestamp_gap", """
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY row) - 1 AS row, t AS timestamp_s FROM v_tel
WHERE NOT (t >= 3e0 AND t < 3e0 + 75e-2)""")
def fault_timestamp_gap(spark, sf_dir):
    return faults.timestamp_gap(fx.telemetry(spark, sf_dir).select("file_id", "row", v.TIMESTAMP), 3.0, 0.75)


@register("fault_nan_burst", """
SELECT file_id, row, CASE WHEN NOT (t >= 5e0 AND t < 5e0 + 2e-1) THEN round(conf, 6) END AS object_confidence FROM v_tel""")
def fault_nan_burst(spark, sf_dir):
    burst = faults.nan_burst(fx.telemetry(spark, sf_dir), v.CONF, 5.0, 0.2)
    return burst.select("file_id", "row", r6(v.CONF).alias(v.CONF))


@register("fault_drop_columns", """
SELECT file_id, CASE WHEN cls = 11 THEN 'object_confidence' ELSE '' END AS missing_critical,
  'ego_acceleration_mps2, weather' AS missing_optional FROM v_files""")
def fault_drop_columns(spark, sf_dir):
    _, files = faults.apply_faults(
        fx.telemetry(spark, sf_dir), fx.provenance(spark, sf_dir),
        faults.Faults(drop_columns=(v.ACCEL, v.WEATHER)))
    return files.select(
        "file_id", F.expr(f"array_join({gates.missing_signals(v.CRITICAL_SIGNALS)}, ', ') AS missing_critical"),
        F.expr(f"array_join({gates.missing_signals(v.OPTIONAL_SIGNALS)}, ', ') AS missing_optional"))


@register("signals_downsample", """
SELECT file_id, row, step, timestamp_s, ego_speed_mps, relative_distance_m FROM (
  SELECT file_id, row, CAST(ceil(count(*) OVER (PARTITION BY file_id) / 1e2) AS BIGINT) AS step, t AS timestamp_s,
    round(speed, 6) AS ego_speed_mps, round(gap, 6) AS relative_distance_m FROM v_tel) x WHERE row % step = 0""")
def signals_downsample(spark, sf_dir):
    from fleetgauge.operators.listings import downsample

    return rounded(
        downsample(fx.telemetry(spark, sf_dir), 100).select(
            "file_id", "row", "step", v.TIMESTAMP, v.SPEED, v.GAP), v.SPEED, v.GAP)


# --- gates -------------------------------------------------------------------------------------


@register("file_timing", """
SELECT e.file_id, round(duration_s, 6) AS duration_s, round(nominal, 9) AS nominal_dt_s
FROM (SELECT file_id, max(t) - min(t) AS duration_s FROM v_tel GROUP BY 1) e
LEFT JOIN (SELECT file_id, median(dt) AS nominal FROM v_intervals WHERE dt > 0 GROUP BY 1) n ON e.file_id = n.file_id""")
def file_timing(spark, sf_dir):
    return gates.file_timing(fx.telemetry(spark, sf_dir)).select(
        "file_id", r6("duration_s").alias("duration_s"), F.round("nominal_dt_s", 9).alias("nominal_dt_s"))


def _gate(name: str):
    def run(spark, sf_dir):
        one = {name: gates.GATES[name]}
        return gates.gate_results(_profile(spark, sf_dir), gates=one).select("file_id", "status", "message")
    return run


for _key, _name in (
    ("gate_required_signals", "required_signals"), ("gate_size", "size"),
    ("gate_timestamps", "timestamp_continuity"), ("gate_missing_values", "missing_values"),
    ("gate_value_ranges", "value_ranges"), ("gate_unit_plausibility", "unit_plausibility"),
    ("gate_scenario_completeness", "scenario_completeness"),
):
    register(_key, f"SELECT file_id, status, message FROM v_gates WHERE gate = '{_name}'")(_gate(_name))


@register("timestamp_gaps", """
SELECT i.file_id, start_s, end_s, CAST(round_even(dt / n.nominal, 0) - 1 AS BIGINT) AS missing_samples
FROM v_intervals i JOIN v_iprof n ON i.file_id = n.file_id
WHERE n.non_increasing = 0 AND dt > 2.5e0 * n.nominal""")
def timestamp_gaps(spark, sf_dir):
    return gates.timestamp_gaps(fx.telemetry(spark, sf_dir))


@register("gate_timestamps_details", """
SELECT file_id, round(nominal, 9) AS nominal_dt_s, round(1e0 / nominal, 6) AS sample_rate_hz, gaps, non_increasing,
  round(missing_s, 6) AS missing_time_s, round(missing_s / extent_s, 6) AS missing_time_fraction FROM v_prof""")
def gate_timestamps_details(spark, sf_dir):
    return _profile(spark, sf_dir).select(
        "file_id", F.round("nominal_dt_s", 9).alias("nominal_dt_s"),
        r6(1.0 / F.col("nominal_dt_s")).alias("sample_rate_hz"), "gaps", "non_increasing",
        r6("missing_time_s").alias("missing_time_s"),
        r6(F.expr(gates.missing_time_fraction())).alias("missing_time_fraction"))


@register("first_failing_rows", """
SELECT file_id, n, row FROM (
  SELECT file_id, row, row_number() OVER (PARTITION BY file_id ORDER BY row) AS n FROM v_intervals WHERE dt <= 0) x
WHERE n <= 10""")
def first_failing_rows(spark, sf_dir):
    return gates.first_failing_rows(fx.telemetry(spark, sf_dir))


@register("missing_value_counts", """
SELECT file_id, signal, n AS count, round(fraction, 6) AS fraction FROM v_nulls""")
def missing_value_counts(spark, sf_dir):
    return rounded(gates.missing_value_counts(_profile(spark, sf_dir)), "fraction")


@register("null_runs", """
SELECT file_id, signal, arg_min(t, row) AS start_s, arg_max(t, row) AS end_s, count(*) AS samples FROM (
  SELECT *, row - row_number() OVER (PARTITION BY file_id, signal ORDER BY row) AS island FROM (
    SELECT file_id, row, t, 'relative_distance_m' AS signal FROM v_tel WHERE gap IS NULL
    UNION ALL SELECT file_id, row, t, 'object_confidence' FROM v_tel WHERE conf IS NULL AND cls <> 11
    UNION ALL SELECT file_id, row, t, 'ego_acceleration_mps2' FROM v_tel WHERE accel IS NULL AND cls <> 10
    UNION ALL SELECT file_id, row, t, 'ego_speed_mps' FROM v_tel WHERE speed IS NULL
    UNION ALL SELECT file_id, row, t, 'relative_velocity_mps' FROM v_tel WHERE rel_v IS NULL) h) i
GROUP BY file_id, signal, island""")
def null_runs(spark, sf_dir):
    return gates.null_runs(fx.telemetry(spark, sf_dir), fx.provenance(spark, sf_dir))


@register("gate_results", "SELECT file_id, gate, status, message FROM v_gates")
def gate_results(spark, sf_dir):
    return gates.gate_results(_profile(spark, sf_dir)).select("file_id", "gate", "status", "message")


@register("quality_verdict", "SELECT file_id, quality_id, verdict, gate_summary, failures, warnings FROM v_quality")
def quality_verdict(spark, sf_dir):
    return gates.quality_verdict(_profile(spark, sf_dir)).drop("warned_gates")


@register("require_analyzable", """
SELECT file_id, 'analysis blocked by data-quality gates (' || quality_id || '): ' || failures AS reason
FROM v_quality WHERE verdict = 'blocked'""")
def require_analyzable(spark, sf_dir):
    return gates.blocked(gates.quality_verdict(_profile(spark, sf_dir)))


@register("custom_gates", """
SELECT file_id, CASE WHEN brake_samples < 350 THEN 'blocked' WHEN cls = 10 THEN 'degraded' WHEN cls = 11 THEN 'blocked' ELSE 'pass' END AS verdict
FROM v_prof""")
def custom_gates(spark, sf_dir):
    def enough_braking(policy):
        return gates.GateOutcome(
            "IF(brake_samples < 350, 'fail', 'pass')",
            "IF(brake_samples < 350, 'too few braking samples', 'enough braking samples')")
    chosen = {"required_signals": gates.gate_required_signals, "enough_braking": enough_braking}
    return gates.quality_verdict(_profile(spark, sf_dir), gates=chosen).select("file_id", "verdict")


# --- events, windows, metrics --------------------------------------------------------------------


@register("detect_events", "SELECT file_id, event_id, event_type, t_s, row, description FROM v_events")
def detect_events(spark, sf_dir):
    return ev.detect_events(fx.telemetry(spark, sf_dir))


@register("build_windows", "SELECT * FROM v_windows")
def build_windows(spark, sf_dir):
    return _analysis(spark, sf_dir).windows


@register("primary_event", "SELECT file_id, anchor_type, anchor_t FROM v_scope")
def primary_event(spark, sf_dir):
    return ev.primary_event(_analysis(spark, sf_dir).profile).select("file_id", "anchor_type", "anchor_t")


@register("slice_window", """
SELECT file_id, count(*) AS samples, min(row) AS first_row, max(row) AS last_row FROM v_slices GROUP BY file_id""")
def slice_window(spark, sf_dir):
    cut = ev.slice_window(
        fx.telemetry(spark, sf_dir).select("file_id", "row", v.TIMESTAMP), _analysis(spark, sf_dir).scope)
    return cut.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("samples"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


@register("rows_in_window", """
SELECT w.file_id, w.window_id, t.row FROM (SELECT file_id, window_id, unnest(range(start_row, end_row + 1)) AS row FROM v_windows) w
JOIN (SELECT file_id, row FROM v_tel) t ON t.file_id = w.file_id AND t.row = w.row""")
def rows_in_window(spark, sf_dir):
    return ev.rows_in_window(fx.telemetry(spark, sf_dir), _analysis(spark, sf_dir).windows)


@register("events_in_window", """
SELECT w.file_id, w.window_id, e.event_id, e.event_type, e.t_s FROM v_windows w JOIN v_aevents e ON w.file_id = e.file_id
WHERE e.row BETWEEN w.start_row AND w.end_row""")
def events_in_window(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return ev.events_in_window(a.events, a.windows)


@register("smooth_centered", """
SELECT file_id, row, round(avg(accel) OVER (PARTITION BY file_id ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS accel_smooth
FROM v_tel""")
def smooth_centered(spark, sf_dir):
    return (
        segments.with_halo(fx.telemetry(spark, sf_dir).select("file_id", "row", v.ACCEL), 2)
        .withColumn("accel_smooth", r6(F.expr(kin.smooth_centered(v.ACCEL, 5))))
        .filter(~F.col("is_halo")).select("file_id", "row", "accel_smooth"))


@register("gradient_nonuniform", """
SELECT file_id, row, round(CASE WHEN t0 IS NULL THEN (y1 - y) / (t1 - t) WHEN t1 IS NULL THEN (y - y0) / (t - t0)
  ELSE ((t - t0) * (t - t0) * y1 + ((t1 - t) * (t1 - t) - (t - t0) * (t - t0)) * y - (t1 - t) * (t1 - t) * y0)
       / ((t - t0) * (t1 - t) * ((t1 - t) + (t - t0))) END, 6) AS slope
FROM (SELECT file_id, row, rel_v AS y, t, lag(t) OVER w AS t0, lead(t) OVER w AS t1, lag(rel_v) OVER w AS y0, lead(rel_v) OVER w AS y1
      FROM v_tel WHERE cls <> 8 WINDOW w AS (PARTITION BY file_id ORDER BY row)) g""")
def gradient_nonuniform(spark, sf_dir):
    # needs increasing timestamps, so logs the continuity gate refuses for order are left out
    tel = fx.telemetry(spark, sf_dir).select("file_id", "row", v.TIMESTAMP, v.REL_V)
    ordered = gates.interval_profile(tel, QualityPolicy()).filter("non_increasing = 0").select("file_id")
    return (
        segments.with_halo(tel.join(ordered, "file_id", "left_semi"), 1)
        .withColumn("slope", r6(F.expr(kin.gradient(v.REL_V, v.TIMESTAMP))))
        .filter(~F.col("is_halo")).select("file_id", "row", "slope"))


_METRIC_COLUMNS = ["file_id", "metric_id", "window_id", "name", "value", "value_bool", "unit", "t_s",
                   "threshold", "threshold_bool", "comparator", "passed", "method", "missing_reason"]
_METRIC_SQL = ("SELECT file_id, metric_id, window_id, name, round(value, 6) AS value, value_bool, unit, t_s, threshold, "
               "threshold_bool, comparator, passed, method, missing_reason FROM v_metrics")


@register("aeb_metrics_report", _METRIC_SQL)
def aeb_metrics_report(spark, sf_dir):
    return rounded(_analysis(spark, sf_dir).metrics.select(*_METRIC_COLUMNS), "value")


def _metric(name: str):
    def run(spark, sf_dir):
        rows = _analysis(spark, sf_dir).metrics.filter(F.col("name") == name)
        return rounded(rows.select("file_id", "value", "value_bool", "t_s", "passed", "missing_reason"), "value")
    return run


for _name in (v.M_MIN_TTC, v.M_CROSSING, v.M_BRAKE, v.M_LATENCY, v.M_SPEED_AT_BRAKE, v.M_MIN_GAP,
              v.M_COLLISION, v.M_COLLISION_TIME, v.M_MAX_DECEL, v.M_MAX_JERK, v.M_FIRST_DETECTION,
              v.M_DROPOUT, v.M_MIN_CONF):
    register(
        f"metric_{_name}",
        "SELECT file_id, round(value, 6) AS value, value_bool, t_s, passed, missing_reason FROM v_metrics "
        f"WHERE name = '{_name}'",
    )(_metric(_name))


@register("metrics_upsert", """
SELECT file_id, metric_id, name, round(coalesce(value, CAST(value_bool AS INT) * 1e0), 6) AS value, unit, passed, t_s, window_id
FROM v_metrics WHERE value IS NOT NULL OR value_bool IS NOT NULL""")
def metrics_upsert(spark, sf_dir):
    """All logs stored with wrong values, then two halves stored again, one of them twice; read from the table."""
    from fleetgauge.sources.tables import stored_metrics, upsert_by_file

    path = f"{shared_folder(spark)}/fleetgauge-metrics-{uuid.uuid4().hex}"
    rows = stored(rounded(stored_metrics(_analysis(spark, sf_dir).metrics), "value"), "metrics")
    upsert_by_file(rows.withColumn("value", F.lit(-1.0)), path, rows, 8)
    for half in (0, 1, 0):
        part = rows.where(F.pmod(F.hash("file_id"), F.lit(2)) == half)
        upsert_by_file(part, path, part, 8)
    return spark.read.parquet(path).drop("bucket")


@register("ingestion_summary", """
SELECT q.file_id, CASE WHEN q.verdict = 'blocked' THEN 'blocked' ELSE 'completed' END AS status, q.verdict AS quality_verdict,
  coalesce(e.n, 0) AS events, coalesce(m.have, 0) AS metrics_available, coalesce(m.miss, 0) AS metrics_missing, p.window_id AS primary_window_id
FROM v_quality q LEFT JOIN (SELECT file_id, count(*) AS n FROM v_aevents GROUP BY 1) e ON q.file_id = e.file_id
LEFT JOIN (SELECT file_id, count(*) FILTER (WHERE value IS NOT NULL OR value_bool IS NOT NULL) AS have,
  count(*) FILTER (WHERE value IS NULL AND value_bool IS NULL) AS miss FROM v_metrics GROUP BY 1) m ON q.file_id = m.file_id
LEFT JOIN v_primary p ON q.file_id = p.file_id""")
def ingestion_summary(spark, sf_dir):
    from fleetgauge.operators.dashboard import ingestion_summary as summary

    return summary(stored_analysis(spark, sf_dir))
