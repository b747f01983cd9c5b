"""Braking metrics per log, computed inside the primary window.

Shape of the plan: one aggregation finds events and scope per log, a binned equi-join cuts the
samples to the windows (a few hundred rows per log), neighbour expressions run on those rows per
segment, and one aggregation per log yields every metric. The long table is an ``inline`` of
that row, so it costs no further shuffle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions import kinematics as kin
from fleetgauge.functions.ids import evidence_scope, stable_id
from fleetgauge.functions.sqltext import compact, num, text
from fleetgauge.operators import events as ev
from fleetgauge.operators import gates
from fleetgauge.operators import segments as sg
from fleetgauge.policies import AebThresholds, QualityPolicy

SCOPE_COLUMNS = ("window_id", "brake_t", "brake_row", "crossing_t", "collision_t")
METRIC_SCHEMA = (
    "array<struct<metric_index:int,name:string,value:double,value_bool:boolean,unit:string,"
    "t_s:double,threshold:double,threshold_bool:boolean,comparator:string,passed:boolean,"
    "method:string,missing_reason:string>>"
)


def derived_signals(slices: DataFrame, thresholds: AebThresholds = AebThresholds()) -> DataFrame:
    """Neighbour-based signals on sliced logs: ttc, dt, both accelerations and both jerks.

    ``accel_fallback`` (from smoothed speed) and its jerk are computed beside the logged ones;
    which pair counts is decided per log, after aggregation.
    """
    k = thresholds.jerk_smoothing_samples
    t = v.TIMESTAMP
    keep = ["file_id", "row", t, v.SPEED, v.ACCEL, v.GAP, v.REL_V, v.CONF, *SCOPE_COLUMNS]
    halo = 2 * (k // 2) + 2
    return (
        sg.with_halo(slices.select(*keep), halo)
        .selectExpr(
            "*", f"{kin.ttc(v.GAP, v.REL_V, thresholds.closing_speed_floor_mps)} AS ttc_s",
            f"{kin.difference(t)} AS dt", f"{kin.smooth_centered(v.ACCEL, k)} AS accel_smooth",
            f"{kin.smooth_centered(v.SPEED, k)} AS speed_smooth")
        .selectExpr("*", f"{kin.gradient('accel_smooth', t)} AS jerk",
                    f"{kin.gradient('speed_smooth', t)} AS accel_fallback")
        .selectExpr("*", f"{kin.smooth_centered('accel_fallback', k)} AS fallback_smooth")
        .selectExpr("*", f"{kin.gradient('fallback_smooth', t)} AS jerk_fallback")
        .filter("NOT is_halo")
        .drop("is_halo", "seg")
    )


def window_measures(samples: DataFrame, thresholds: AebThresholds = AebThresholds()) -> DataFrame:
    """One row per log with every measured quantity of its analysed samples.

    The scope columns are constant per log and pass through the aggregation, so the scope table
    is read once, by the slicing join. Extremes carry the time of their first row.
    """
    t, slack = v.TIMESTAMP, num(ev.EDGE_SLACK_S)
    moving = f"{v.SPEED} > {num(thresholds.closing_speed_floor_mps)}"
    limit = num(thresholds.detection_confidence_threshold)
    risky = (f"crossing_t IS NOT NULL AND {t} >= crossing_t - {slack} "
             f"AND (brake_t IS NULL OR {t} <= brake_t + {slack})")
    below = f"{risky} AND {v.CONF} < {limit}"

    def lowest(x: str, when: str = "true") -> str:
        return f"min(CASE WHEN {x} IS NOT NULL AND {when} THEN named_struct('x', {x}, 'r', row, 't', {t}) END)"

    def highest(x: str, when: str) -> str:
        return f"max(CASE WHEN {x} IS NOT NULL AND {when} THEN named_struct('x', {x}, 'r', -row, 't', {t}) END)"

    measures = {
        **{c: f"max({c})" for c in SCOPE_COLUMNS},
        "min_ttc": lowest("ttc_s"),
        "min_gap": lowest(v.GAP),
        "min_accel": lowest(v.ACCEL),
        "min_fallback": lowest("accel_fallback"),
        "max_jerk": highest("abs(jerk)", moving),
        "max_jerk_fallback": highest("abs(jerk_fallback)", moving),
        "min_conf": lowest(v.CONF, f"({risky})"),
        "speed_at_brake": f"max(CASE WHEN row = brake_row THEN {v.SPEED} END)",
        "first_detection_t": f"min_by({t}, CASE WHEN {v.CONF} >= {limit} THEN row END)",
        "risk_rows": f"count_if({risky})",
        "below_rows": f"count_if({below})",
        "first_below_t": f"min_by({t}, CASE WHEN {below} THEN row END)",
        # only slices with a crossing feed this, and those are a few seconds long
        "window_dt": "percentile(CASE WHEN crossing_t IS NOT NULL THEN dt END, 0.5)",
    }
    return samples.groupBy("file_id").agg(*[F.expr(f"{sql} AS {name}") for name, sql in measures.items()])


def metric_rows(
    measures: DataFrame, provenance: DataFrame, thresholds: AebThresholds = AebThresholds()
) -> DataFrame:
    """Long metric table. Unavailable metrics stay, with a reason and without a value."""
    th = thresholds
    k, floor = th.jerk_smoothing_samples, th.closing_speed_floor_mps
    has = lambda s: f"array_contains(present, '{s}')"
    rows: list[str] = []

    def absent(*signals: str) -> str:
        names = compact(*[(f"NOT {has(s)}", text(s)) for s in signals])
        return f"CASE WHEN size({names}) > 0 THEN concat('signal(s) missing: ', array_join({names}, ', ')) END"

    def metric(name, unit, value, method, t_s="CAST(NULL AS DOUBLE)", op=None, limit=None, reason="NULL",
               emit=None, flag=None):
        found = f"({flag or value}) IS NOT NULL"
        numeric_limit = num(limit) if op and flag is None else None
        sql_limit = str(limit).lower() if flag else numeric_limit
        row = "named_struct(" + ", ".join([
            f"'metric_index', {len(rows)}", f"'name', {text(name)}",
            f"'value', {value if flag is None else 'CAST(NULL AS DOUBLE)'}",
            f"'value_bool', {flag or 'CAST(NULL AS BOOLEAN)'}", f"'unit', {text(unit)}",
            f"'t_s', CASE WHEN {found} THEN {t_s} END",
            f"'threshold', CASE WHEN {found} THEN {numeric_limit or 'CAST(NULL AS DOUBLE)'} END",
            f"'threshold_bool', CASE WHEN {found} THEN {sql_limit if flag else 'CAST(NULL AS BOOLEAN)'} END",
            f"'comparator', CASE WHEN {found} THEN {text(op) if op else 'CAST(NULL AS STRING)'} END",
            f"'passed', {kin.threshold_verdict(flag or f'({value})', op, sql_limit)}",
            f"'method', {method}", f"'missing_reason', CASE WHEN NOT ({found}) THEN {reason} END",
        ]) + ")"
        rows.append(f"CASE WHEN {emit} THEN {row} END" if emit else row)

    ttc_method = text("relative_distance / (-relative_velocity) per sample, undefined when closing speed "
                      f"<= {floor} m/s")
    ttc_absent = absent(v.GAP, v.REL_V)
    crossed = text(f"first sample with TTC <= {th.trigger_ttc_s} s")
    metric(v.M_MIN_TTC, "s", "min_ttc.x", ttc_method, "min_ttc.t", ">=", th.min_acceptable_ttc_s,
           f"coalesce({ttc_absent}, 'ego never closes on the lead')")
    metric(v.M_CROSSING, "s", "crossing_t",
           f"CASE WHEN {has(v.GAP)} AND {has(v.REL_V)} THEN {crossed} ELSE {ttc_method} END", "crossing_t",
           reason=f"coalesce({ttc_absent}, 'TTC never fell to {th.trigger_ttc_s} s')")
    metric(v.M_BRAKE, "s", "brake_t",
           "CASE WHEN brake_t IS NULL THEN 'brake_command rising edge' "
           "ELSE 'first sample with brake_command == 1' END", "brake_t",
           reason=f"coalesce({absent(v.BRAKE)}, 'brake_command never asserted')")
    metric(v.M_LATENCY, "s", "round(brake_t - crossing_t, 6)",
           "'brake_command_time_s - ttc_threshold_crossing_s'", "brake_t", "<=", th.max_braking_latency_s,
           "CASE WHEN brake_t IS NULL THEN 'no brake command' ELSE 'no TTC threshold crossing' END")
    metric(v.M_SPEED_AT_BRAKE, "m/s", "speed_at_brake", "'ego_speed at brake command sample'", "brake_t",
           emit="speed_at_brake IS NOT NULL")
    metric(v.M_MIN_GAP, "m", "min_gap.x", "'min relative_distance'", "min_gap.t",
           reason=f"coalesce({absent(v.GAP)}, 'no distance samples')")
    within = text(f"any sample with relative_distance <= {th.collision_gap_m} m")
    metric(v.M_COLLISION, "bool", "NULL",
           f"CASE WHEN {has(v.GAP)} THEN {within} ELSE 'relative_distance <= gap' END", "collision_t", "==",
           False, absent(v.GAP), flag=f"(CASE WHEN {has(v.GAP)} THEN collision_t IS NOT NULL END)")
    metric(v.M_COLLISION_TIME, "s", "collision_t", "'first collision sample'", "collision_t",
           emit=f"{has(v.GAP)} AND collision_t IS NOT NULL")

    decel = "(CASE WHEN min_accel IS NOT NULL THEN min_accel ELSE min_fallback END)"
    jerk = "(CASE WHEN min_accel IS NOT NULL THEN max_jerk ELSE max_jerk_fallback END)"
    smoothed = text(f"d(ego_speed)/dt with {k}-sample centred moving average (acceleration signal not logged)")
    source = (f"CASE WHEN min_accel IS NOT NULL THEN 'logged ego_acceleration' "
              f"WHEN min_fallback IS NOT NULL THEN {smoothed} END")
    metric(v.M_MAX_DECEL, "m/s^2", f"-{decel}.x", f"coalesce(concat('max(-a) from ', {source}), 'n/a')",
           f"{decel}.t", "<=", th.max_deceleration_mps2, "'no acceleration or speed'")
    on = text(f"max |d(a)/dt| with {k}-sample centred moving average on ")
    metric(v.M_MAX_JERK, "m/s^3", f"{jerk}.x",
           f"coalesce(concat({on}, {source}, ', while ego_speed > {floor} m/s'), 'n/a')", f"{jerk}.t", "<=",
           th.max_comfort_jerk_mps3,
           f"CASE WHEN {decel} IS NULL THEN 'no acceleration or speed' ELSE 'ego never moving' END")

    limit = th.detection_confidence_threshold
    conf_absent = absent(v.CONF)
    metric(v.M_FIRST_DETECTION, "s", "first_detection_t",
           f"CASE WHEN {has(v.CONF)} THEN 'first sample with object_confidence >= {limit}' "
           "ELSE 'confidence >= threshold' END", "first_detection_t",
           reason=f"coalesce({conf_absent}, 'object_confidence never reached {limit}')")
    at_risk = f"({has(v.CONF)} AND crossing_t IS NOT NULL AND risk_rows > 0)"
    counted = text(f"samples with object_confidence < {limit} between TTC crossing and brake command, "
                   "times nominal dt")
    metric(v.M_DROPOUT, "s", f"CASE WHEN {at_risk} THEN round(below_rows * coalesce(window_dt, 0D), 6) END",
           f"CASE WHEN {at_risk} THEN {counted} ELSE 'confidence < threshold' END", "first_below_t", "<=", 0.0,
           f"coalesce({conf_absent}, 'no TTC threshold crossing')",
           emit=f"{at_risk} OR NOT {has(v.CONF)} OR crossing_t IS NULL")
    metric(v.M_MIN_CONF, "ratio", "min_conf.x",
           "'min object_confidence between TTC crossing and brake command'", "min_conf.t", ">=", limit,
           "'no confidence samples in the risk phase'", emit=at_risk)
    return (
        measures.join(provenance.select("file_id", "present"), "file_id")
        .selectExpr("file_id", "window_id",
                    f"inline(CAST(array_compact(array({', '.join(rows)})) AS {METRIC_SCHEMA}))")
        .withColumn("metric_id", stable_id("metric", evidence_scope(F.col("file_id"), th), F.col("name")))
    )


def available(metrics: DataFrame) -> DataFrame:
    return metrics.filter(is_available())


def is_available() -> Column:
    return F.col("value").isNotNull() | F.col("value_bool").isNotNull()


def numeric_value() -> Column:
    """Stored form of a metric value: flags become 1.0 / 0.0."""
    return F.coalesce(F.col("value"), F.col("value_bool").cast("int").cast("double"))


def compute_metrics(
    telemetry: DataFrame, provenance: DataFrame, scope: DataFrame,
    thresholds: AebThresholds = AebThresholds(),
) -> DataFrame:
    """Metrics for the logs in ``scope``."""
    used = ["file_id", "row", v.TIMESTAMP, v.SPEED, v.ACCEL, v.GAP, v.REL_V, v.CONF]
    kept = scope.select("file_id", "lo_t", "hi_t", *SCOPE_COLUMNS)
    slices = ev.slice_window(telemetry.select(*used), kept)
    measures = window_measures(derived_signals(slices, thresholds), thresholds)
    return metric_rows(measures, provenance, thresholds)


def log_profile(
    telemetry: DataFrame, provenance: DataFrame, thresholds: AebThresholds = AebThresholds(),
    policy: QualityPolicy = QualityPolicy(),
) -> DataFrame:
    """Gate counters, verdict and event times, one row per log, from one pass plus the interval pass."""
    telemetry = gates.without_nan(telemetry)
    return gates.judge(
        gates.quality_profile(telemetry, provenance, policy, ev.event_aggregates(thresholds)), policy)


class Analysis:
    """Gate-enforced analysis of the logs in ``profile`` (see ``log_profile``).

    Blocked logs have a quality row and nothing else. Every part is a lazy DataFrame, built when
    asked for. The profile (one row per log) is read by each of them, so hand in a stored one.
    """

    def __init__(self, telemetry: DataFrame, provenance: DataFrame, profile: DataFrame,
                 thresholds: AebThresholds = AebThresholds()):
        self.telemetry, self.provenance, self.thresholds = gates.without_nan(telemetry), provenance, thresholds
        self.everything = profile

    @cached_property
    def quality(self) -> DataFrame:
        return gates.quality_report(self.everything)

    @cached_property
    def profile(self) -> DataFrame:
        """Analysable logs only."""
        return self.everything.filter("verdict <> 'blocked'").drop("gates")

    @cached_property
    def events(self) -> DataFrame:
        return ev.events_from_profile(self.profile, self.thresholds).select(
            "file_id", "event_id", "event_type", "t_s", "row", "description")

    @cached_property
    def scope(self) -> DataFrame:
        return ev.analysis_scope(self.profile, self.thresholds)

    @cached_property
    def windows(self) -> DataFrame:
        return ev.build_windows(self.telemetry, self.profile, self.thresholds)

    @cached_property
    def metrics(self) -> DataFrame:
        return compute_metrics(self.telemetry, self.provenance, self.scope, self.thresholds)
