"""Data-quality gates per log.

Two aggregations read the telemetry: one partial-aggregating pass for all counters, and one
pass over ``(file_id, row, timestamp_s)`` for sample intervals, which are counted per distinct
length before anything else happens. Gates are expressions on the resulting row per log.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions.ids import stable_id
from fleetgauge.functions.sqltext import compact, num, text, texts
from fleetgauge.operators import segments as sg
from fleetgauge.policies import QualityPolicy

CLOSING_NOISE_MPS = 0.5


# --- sample intervals ------------------------------------------------------------------------


def sample_intervals(telemetry: DataFrame) -> DataFrame:
    """Interval between neighbouring rows: ``file_id,row,start_s,end_s,dt``; ``row`` is the later."""
    frame = sg.segment_frame()
    return (
        sg.with_halo(telemetry.select("file_id", "row", v.TIMESTAMP), 1)
        .withColumn("start_s", F.lag(v.TIMESTAMP).over(frame))
        .filter(~F.col("is_halo"))
        .select(
            "file_id", "row", "start_s", F.col(v.TIMESTAMP).alias("end_s"),
            (F.col(v.TIMESTAMP) - F.col("start_s")).alias("dt"),
        )
        .filter(F.col("dt").isNotNull())
    )


def interval_profile(telemetry: DataFrame, policy: QualityPolicy) -> DataFrame:
    """Per log: non-increasing count, nominal dt, gaps and missing time, from a dt histogram."""
    counts = sample_intervals(telemetry).groupBy("file_id", "dt").agg(F.count(F.lit(1)).alias("n"))
    nominal = sg.exact_median(counts, "file_id", "dt", "n", "nominal_dt_s")
    gap = F.col("dt") > policy.gap_factor * F.col("nominal_dt_s")
    return (
        counts.join(nominal, "file_id")
        .groupBy("file_id")
        .agg(
            F.max("nominal_dt_s").alias("nominal_dt_s"),
            F.sum(F.when(F.col("dt") <= 0, F.col("n")).otherwise(0)).alias("non_increasing"),
            F.sum(F.when(gap, F.col("n")).otherwise(0)).alias("gaps"),
            F.sum(
                F.when(gap, F.col("n") * (F.col("dt") - F.col("nominal_dt_s"))).otherwise(0.0)
            ).alias("missing_time_s"),
        )
    )


def timestamp_gaps(telemetry: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """Every gap of logs whose timestamps increase: start, end and missing samples."""
    intervals = sample_intervals(telemetry)
    profile = interval_profile(telemetry, policy).filter("non_increasing = 0 and gaps > 0")
    return (
        intervals.join(profile.select("file_id", "nominal_dt_s"), "file_id")
        .filter(F.col("dt") > policy.gap_factor * F.col("nominal_dt_s"))
        .select(
            "file_id", "start_s", "end_s",
            (F.bround(F.col("dt") / F.col("nominal_dt_s")) - 1).cast("bigint").alias("missing_samples"),
        )
    )


def first_failing_rows(telemetry: DataFrame, limit: int = 10) -> DataFrame:
    """The first rows per log whose timestamp does not increase."""
    order = Window.partitionBy("file_id").orderBy("row")
    return (
        sample_intervals(telemetry)
        .filter(F.col("dt") <= 0)
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= limit)
        .select("file_id", F.col("n").cast("bigint").alias("n"), "row")
    )


def file_timing(telemetry: DataFrame) -> DataFrame:
    """Duration and median positive interval over the samples that have a timestamp.

    Missing timestamps are skipped, however many: intervals inside a segment come from a window,
    those between segments from the first and last timestamp of each segment.
    """
    t = F.col(v.TIMESTAMP)
    src = telemetry.select("file_id", "row", v.TIMESTAMP).withColumn("seg", sg.segment_of(F.col("row")))
    before = sg.segment_frame().rowsBetween(Window.unboundedPreceding, -1)
    inner = (
        src.filter(t.isNotNull())
        .withColumn("dt", t - F.last(v.TIMESTAMP).over(before))
        .filter("dt is not null")
        .select("file_id", "dt")
    )
    heads = src.filter(t.isNotNull()).groupBy("file_id", "seg").agg(
        F.min_by(v.TIMESTAMP, "row").alias("head"), F.max_by(v.TIMESTAMP, "row").alias("tail"),
        F.count(t).alias("samples"), F.min(t).alias("t_min"), F.max(t).alias("t_max"),
    )
    over_file = Window.partitionBy("file_id").orderBy("seg")
    edges = (
        heads.withColumn("dt", F.col("head") - F.lag("tail").over(over_file))
        .filter("dt is not null")
        .select("file_id", "dt")
    )
    counts = inner.unionByName(edges).filter("dt > 0").groupBy("file_id", "dt").agg(
        F.count(F.lit(1)).alias("n"))
    nominal = sg.exact_median(counts, "file_id", "dt", "n", "nominal_dt_s")
    extent = heads.groupBy("file_id").agg(
        F.sum("samples").alias("samples"),
        (F.max("t_max") - F.min("t_min")).alias("duration_s"),
    )
    return extent.join(nominal, "file_id", "left").select(
        "file_id",
        F.when(F.col("samples") >= 2, F.col("duration_s")).alias("duration_s"),
        "nominal_dt_s",
    )


# --- one row per log -----------------------------------------------------------------------


RANGE_SIGNALS = (v.SPEED, v.GAP, v.CONF, v.BRAKE)
PEAK_SIGNALS = (v.SPEED, v.REL_V, v.GAP, v.ACCEL)
COUNTERS = (
    "rows", "t_samples", "extent_s", *[f"null_{s}" for s in v.SIGNALS],
    *[f"bad_{s}" for s in RANGE_SIGNALS], *[f"peak_{s}" for s in PEAK_SIGNALS],
    "brake_samples", "closing_samples",
)


def without_nan(telemetry: DataFrame) -> DataFrame:
    """NaN samples as missing ones; Spark takes NaN for a value above all others."""
    floating = {name for name, kind in telemetry.dtypes if kind in ("double", "float")}
    return telemetry.withColumns({c: F.expr(f"nanvl({c}, NULL)") for c in (v.TIMESTAMP, *v.SIGNALS) if c in floating})


def signal_counters() -> list[Column]:
    """Counters of all gates, for one pass per log."""
    t = v.TIMESTAMP
    bad = {
        v.SPEED: f"{v.SPEED} < 0", v.GAP: f"{v.GAP} < 0", v.CONF: f"{v.CONF} < 0 OR {v.CONF} > 1",
        v.BRAKE: f"{v.BRAKE} NOT IN (0, 1)",
    }
    text = {
        "rows": "count(1)", "t_samples": f"count({t})", "extent_s": f"max({t}) - min({t})",
        **{f"null_{s}": f"count_if({s} IS NULL)" for s in v.SIGNALS},
        **{f"bad_{s}": f"count_if({rule})" for s, rule in bad.items()},
        **{f"peak_{s}": f"coalesce(max(abs({s})), 0D)" for s in PEAK_SIGNALS},
        "brake_samples": f"count_if({v.BRAKE} = 1)",
        "closing_samples": f"count_if({v.REL_V} < {num(-CLOSING_NOISE_MPS)})",
    }
    return [F.expr(f"{text[name]} AS {name}") for name in COUNTERS]


def quality_profile(
    telemetry: DataFrame, provenance: DataFrame, policy: QualityPolicy = QualityPolicy(),
    also: list[Column] | None = None,
) -> DataFrame:
    """Everything the gates need, one row per log of ``provenance`` (logs without rows too).

    ``also``: further aggregates for the same pass, such as those of the event detection.
    """
    counted = telemetry.groupBy("file_id").agg(*signal_counters(), *(also or []))
    joined = (
        provenance.select("file_id", "present")
        .join(counted, "file_id", "left")
        .join(interval_profile(telemetry, policy), "file_id", "left")
    )
    zero = [n for n in COUNTERS if not n.startswith("peak_") and n != "extent_s"]
    return joined.fillna(0, subset=[*zero, "non_increasing", "gaps"]).fillna(
        0.0, subset=["missing_time_s", *[n for n in COUNTERS if n.startswith("peak_")]]
    )


# --- gates: policy -> SQL text over the profile -------------------------------------------------


class GateOutcome(NamedTuple):
    """Two independent SQL expressions: a plan that needs only the verdict builds no messages."""

    status: str
    message: str


GateFn = Callable[[QualityPolicy], GateOutcome]


def _result(default: str, *cases: tuple[str, str, str]) -> GateOutcome:
    """First ``(condition, status, message)`` that holds, else pass with the default message."""
    status = " ".join(f"WHEN {condition} THEN '{label}'" for condition, label, _ in cases)
    message = " ".join(f"WHEN {condition} THEN {words}" for condition, _, words in cases)
    return GateOutcome(f"CASE {status} ELSE 'pass' END", f"CASE {message} ELSE {default} END")


def _present(signal: str) -> str:
    return f"array_contains(present, '{signal}')"


def missing_signals(signals: tuple[str, ...]) -> str:
    return f"array_except(array({texts(signals)}), present)"


def gate_required_signals(policy: QualityPolicy) -> GateOutcome:
    critical = missing_signals(policy.critical_signals)
    optional = missing_signals(policy.optional_signals)
    return _result(
        "'all signals present'",
        (f"size({critical}) > 0", "fail",
         f"concat('critical signals missing: ', array_join({critical}, ', '))"),
        (f"size({optional}) > 0", "warn",
         f"concat('optional signals missing: ', array_join({optional}, ', '))"),
    )


def duration() -> str:
    return f"CASE WHEN {_present(v.TIMESTAMP)} AND t_samples >= 2 THEN extent_s END"


def gate_size(policy: QualityPolicy) -> GateOutcome:
    return _result(
        f"concat(rows, ' rows, ', coalesce(string({duration()}), 'None'), ' s')",
        (f"rows < {policy.min_rows}", "fail", f"concat(rows, ' rows < minimum {policy.min_rows}')"),
        (f"({duration()}) < {num(policy.min_duration_s)}", "fail",
         f"concat('duration ', format_string('%.2f', {duration()}), ' s < minimum {policy.min_duration_s} s')"),
    )


def missing_time_fraction() -> str:
    return "coalesce(try_divide(missing_time_s, extent_s), 0D)"


def gate_timestamps(policy: QualityPolicy) -> GateOutcome:
    nulls, share = f"null_{v.TIMESTAMP}", missing_time_fraction()
    missing = "format_string('%.2f', missing_time_s)"
    limit = policy.max_missing_time_fraction
    return _result(
        "concat('continuous at ', format_string('%.1f', 1D / nominal_dt_s), ' Hz')",
        (f"NOT {_present(v.TIMESTAMP)}", "fail", "'timestamp column missing'"),
        (f"{nulls} > 0", "fail", f"concat({nulls}, ' timestamps are missing or non-numeric')"),
        ("rows < 2", "fail", "'fewer than two samples'"),
        ("non_increasing > 0", "fail",
         "concat(non_increasing, ' non-increasing timestamps (duplicates or reordering)')"),
        (f"{share} > {num(limit)}", "fail",
         f"concat(gaps, ' gap(s) covering ', {missing}, ' s (', format_string('%.0f', {share} * 100), "
         f"'% of log) exceed {limit:.0%}')"),
        ("gaps > 0", "warn", f"concat(gaps, ' timestamp gap(s) totalling ', {missing}, ' s')"),
    )


def null_fraction(signal: str) -> str:
    """Share of missing samples; 0 for an absent column (the signal gate reports that)."""
    return f"IF({_present(signal)}, coalesce(try_divide(null_{signal}, rows), 0D), 0D)"


def gate_missing_values(policy: QualityPolicy) -> GateOutcome:
    def hit(signals: tuple[str, ...]) -> str:
        return compact(*[(f"{null_fraction(s)} > 0", text(s)) for s in signals if s != v.TIMESTAMP])
    critical = hit(policy.critical_signals)
    every = hit((*policy.critical_signals, *policy.optional_signals))
    shares = [null_fraction(s) for s in policy.critical_signals if s != v.TIMESTAMP]
    worst = f"array_max(array({', '.join(shares)}))"
    limit = policy.max_nan_fraction
    return _result(
        "'no missing values'",
        (f"{worst} > {num(limit)}", "fail",
         f"concat('critical signal(s) ', array_join({critical}, ', '), ' missing ', "
         f"format_string('%.1f', {worst} * 100), '% of samples (> {limit:.0%})')"),
        (f"size({every}) > 0", "warn", f"concat('missing values in: ', array_join({every}, ', '))"),
    )


def gate_value_ranges(policy: QualityPolicy) -> GateOutcome:
    found = compact(*[(f"bad_{s} > 0", f"concat('{s} (', bad_{s}, ')')") for s in RANGE_SIGNALS])
    return _result(
        "'all values in range'",
        (f"size({found}) > 0", "fail", f"concat('out-of-range values: ', array_join({found}, ', '))"),
    )


def gate_unit_plausibility(policy: QualityPolicy) -> GateOutcome:
    def over(*limits: tuple[str, float]) -> str:
        return compact(*[
            (f"{_present(s)} AND peak_{s} > {num(limit)}",
             f"concat('{s} peaks at ', format_string('%.1f', peak_{s}), ' (ceiling {limit})')")
            for s, limit in limits
        ])
    hard = over((v.SPEED, policy.max_plausible_speed_mps), (v.REL_V, policy.max_plausible_speed_mps))
    soft = over((v.GAP, policy.max_plausible_distance_m), (v.ACCEL, policy.max_plausible_accel_mps2))
    return _result(
        "'magnitudes plausible for SI'",
        (f"size({hard}) > 0", "fail",
         f"concat('implausible magnitudes, check units: ', array_join({hard}, '; '))"),
        (f"size({soft}) > 0", "warn", f"array_join({soft}, '; ')"),
    )


def gate_scenario_completeness(policy: QualityPolicy) -> GateOutcome:
    notes = compact(
        (f"{_present(v.BRAKE)} AND brake_samples = 0",
         "'no brake command in log; braking-latency metrics unavailable'"),
        (f"{_present(v.REL_V)} AND closing_samples = 0",
         "'ego never closes on the lead; no TTC-relevant episode'"),
    )
    return _result(
        "'brake event and closing phase present'",
        (f"size({notes}) > 0", "warn", f"array_join({notes}, '; ')"),
    )


GATES: dict[str, GateFn] = {
    "required_signals": gate_required_signals,
    "size": gate_size,
    "timestamp_continuity": gate_timestamps,
    "missing_values": gate_missing_values,
    "value_ranges": gate_value_ranges,
    "unit_plausibility": gate_unit_plausibility,
    "scenario_completeness": gate_scenario_completeness,
}


def gate_results(
    profile: DataFrame,
    policy: QualityPolicy = QualityPolicy(),
    gates: dict[str, GateFn] | None = None,
) -> DataFrame:
    """``file_id,gate_index,gate,status,message`` — one row per log and gate.

    ``gates`` may be any mapping of name to gate function: a subset, or functions of the caller.
    """
    chosen = GATES if gates is None else gates
    outcomes = [(n, fn(policy)) for n, fn in chosen.items()]
    rows = ", ".join(
        f"named_struct('gate_index', {i}, 'gate', {text(n)}, 'status', {o.status}, 'message', {o.message})"
        for i, (n, o) in enumerate(outcomes))
    return profile.selectExpr("file_id", f"inline(array({rows}))")


def judge(
    profile: DataFrame,
    policy: QualityPolicy = QualityPolicy(),
    gates: dict[str, GateFn] | None = None,
) -> DataFrame:
    """The profile with ``gates`` (array of gate, status, message), ``verdict`` and ``quality_id``.

    This is the table to store: later steps read the verdict as a plain column instead of carrying
    the expressions of all gates through their plans.
    """
    chosen = GATES if gates is None else gates
    outcomes = [(n, fn(policy)) for n, fn in chosen.items()]
    array = ", ".join(
        f"named_struct('gate', {text(n)}, 'status', {o.status}, 'message', {o.message})" for n, o in outcomes)
    return profile.selectExpr("*", f"array({array}) AS gates").selectExpr(
        "*", "CASE WHEN exists(gates, g -> g.status = 'fail') THEN 'blocked' "
        "WHEN exists(gates, g -> g.status = 'warn') THEN 'degraded' ELSE 'pass' END AS verdict",
    ).withColumn("quality_id", quality_id(policy))


def quality_report(judged: DataFrame) -> DataFrame:
    """``file_id,quality_id,verdict,gate_summary,failures,warnings,warned_gates`` per log."""
    def having(status: str, shown: str, sep: str) -> str:
        return f"array_join(transform(filter(gates, g -> g.status = '{status}'), g -> {shown}), '{sep}')"

    worded = "concat(g.gate, ': ', g.message)"
    return judged.selectExpr(
        "file_id", "quality_id", "verdict",
        "array_join(transform(gates, g -> concat(g.gate, '=', g.status)), '; ') AS gate_summary",
        f"{having('fail', worded, '; ')} AS failures",
        f"{having('warn', worded, '; ')} AS warnings",
        f"{having('warn', 'g.gate', ', ')} AS warned_gates",
    )


def quality_verdict(
    profile: DataFrame,
    policy: QualityPolicy = QualityPolicy(),
    gates: dict[str, GateFn] | None = None,
) -> DataFrame:
    return quality_report(judge(profile, policy, gates))


def quality_id(policy: QualityPolicy = QualityPolicy()) -> Column:
    return stable_id("quality", F.col("file_id"), policy.to_json())


def analyzable(quality: DataFrame) -> DataFrame:
    return quality.filter(F.col("verdict") != "blocked")


def blocked(quality: DataFrame) -> DataFrame:
    """Logs that may not be analysed, with the reason text."""
    return quality.filter(F.col("verdict") == "blocked").select(
        "file_id",
        F.concat(
            F.lit("analysis blocked by data-quality gates ("), F.col("quality_id"), F.lit("): "),
            F.col("failures"),
        ).alias("reason"),
    )


# --- details of the missing-values gate ----------------------------------------------------


def missing_value_counts(profile: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """Count and share of missing samples per log and signal that has any."""
    signals = [s for s in (*policy.critical_signals, *policy.optional_signals) if s != v.TIMESTAMP]
    rows = ", ".join(
        f"named_struct('signal', '{s}', 'count', null_{s}, 'fraction', {null_fraction(s)})" for s in signals)
    return profile.selectExpr("file_id", f"inline(array({rows}))").filter("fraction > 0")


def null_runs(telemetry: DataFrame, provenance: DataFrame) -> DataFrame:
    """Contiguous missing stretches per present signal: ``start_s,end_s,samples``.

    Samples meet only samples of their own segment. Pieces are found per segment; only the pieces that touch a
    segment edge (two per segment at most) are stitched over the whole log, and whether a log has the signal at all is
    asked of the pieces, not of the samples. A NaN is missing.
    """
    signals = [s for s in v.SIGNALS if s != v.TIMESTAMP]
    missing = compact(*[(f"{s} IS NULL", text(s)) for s in signals])
    holes = (
        without_nan(telemetry).filter(" OR ".join(f"{s} IS NULL" for s in signals))
        .select("file_id", "row", F.col(v.TIMESTAMP).alias("t"), F.expr(f"explode({missing}) AS signal"))
        .withColumn("seg", sg.segment_of(F.col("row")))
    )
    order = Window.partitionBy("file_id", "signal", "seg").orderBy("row")
    pieces = (
        holes.withColumn("island", F.col("row") - F.row_number().over(order))
        .groupBy("file_id", "signal", "seg", "island")
        .agg(
            F.min("row").alias("first_row"), F.max("row").alias("last_row"),
            F.min_by("t", "row").alias("start_s"), F.max_by("t", "row").alias("end_s"),
        )
        .drop("island")
        .join(provenance.select("file_id", F.explode("present").alias("signal")), ["file_id", "signal"], "left_semi")
    )
    touches = (F.col("first_row") % sg.SEGMENT_ROWS == 0) | (
        F.col("last_row") % sg.SEGMENT_ROWS == sg.SEGMENT_ROWS - 1)
    over_log = Window.partitionBy("file_id", "signal").orderBy("first_row")
    stitched = (
        pieces.filter(touches)
        .withColumn("opens", (
            F.lag("last_row").over(over_log).isNull()
            | (F.lag("last_row").over(over_log) + 1 != F.col("first_row"))
        ).cast("int"))
        .withColumn("run", F.sum("opens").over(over_log))
        .groupBy("file_id", "signal", "run")
        .agg(
            F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"),
            F.min_by("start_s", "first_row").alias("start_s"),
            F.max_by("end_s", "first_row").alias("end_s"),
        )
        .drop("run")
    )
    return pieces.filter(~touches).drop("seg").unionByName(stitched).select(
        "file_id", "signal", "start_s", "end_s",
        (F.col("last_row") - F.col("first_row") + 1).alias("samples"),
    )
