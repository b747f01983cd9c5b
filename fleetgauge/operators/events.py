"""Braking events and the windows around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions.ids import evidence_scope, stable_id
from fleetgauge.functions.kinematics import ttc
from fleetgauge.functions.sqltext import num
from fleetgauge.operators import segments as sg
from fleetgauge.policies import AebThresholds

EDGE_SLACK_S = 1e-9


def event_id(file_id: Column, kind: Column | str, thresholds: AebThresholds) -> Column:
    return stable_id("event", evidence_scope(file_id, thresholds), kind)


def window_id(file_id: Column, kind: Column | str, thresholds: AebThresholds) -> Column:
    scope = evidence_scope(file_id, thresholds)
    return stable_id("window", scope, event_id(file_id, kind, thresholds))


def descriptions(thresholds: AebThresholds) -> dict[str, str]:
    return {
        v.EV_BRAKE: "first sample with brake_command == 1",
        v.EV_CROSSING: f"first sample with TTC <= {thresholds.trigger_ttc_s} s",
        v.EV_COLLISION: f"first sample with relative_distance <= {thresholds.collision_gap_m} m",
    }


def event_aggregates(thresholds: AebThresholds = AebThresholds()) -> list[Column]:
    """First row and time of each event per log, plus the log's first and last time.

    Only primitive aggregation buffers, so the pass partial-aggregates before it shuffles.
    """
    hits = {
        "brake": f"{v.BRAKE} = 1",
        "crossing": f"({ttc(v.GAP, v.REL_V, thresholds.closing_speed_floor_mps)}) <= {num(thresholds.trigger_ttc_s)}",
        "collision": f"{v.GAP} <= {num(thresholds.collision_gap_m)}",
    }
    aggs = []
    for name, hit in hits.items():
        aggs += [f"min(CASE WHEN {hit} THEN row END) AS {name}_row",
                 f"min_by({v.TIMESTAMP}, CASE WHEN {hit} THEN row END) AS {name}_t"]
    aggs += [f"min_by({v.TIMESTAMP}, row) AS first_t", f"max_by({v.TIMESTAMP}, row) AS last_t"]
    return [F.expr(a) for a in aggs]


def event_profile(telemetry: DataFrame, thresholds: AebThresholds = AebThresholds()) -> DataFrame:
    return telemetry.groupBy("file_id").agg(*event_aggregates(thresholds))


def events_from_profile(
    profile: DataFrame, thresholds: AebThresholds = AebThresholds()
) -> DataFrame:
    text = descriptions(thresholds)
    items = F.array(*[
        F.struct(
            F.lit(kind).alias("event_type"), F.col(f"{name}_t").alias("t_s"),
            F.col(f"{name}_row").alias("row"), F.lit(text[kind]).alias("description"),
        )
        for name, kind in (
            ("brake", v.EV_BRAKE), ("crossing", v.EV_CROSSING), ("collision", v.EV_COLLISION))
    ])
    return (
        profile.select("file_id", "first_t", "last_t", F.inline(items))
        .filter(F.col("row").isNotNull())
        .withColumn("event_id", event_id(F.col("file_id"), F.col("event_type"), thresholds))
    )


def detect_events(telemetry: DataFrame, thresholds: AebThresholds = AebThresholds()) -> DataFrame:
    """``file_id,event_id,event_type,t_s,row,description``; time order is ``(t_s, event_type)``."""
    return events_from_profile(event_profile(telemetry, thresholds), thresholds).select(
        "file_id", "event_id", "event_type", "t_s", "row", "description")


def build_windows(
    telemetry: DataFrame, profile: DataFrame, thresholds: AebThresholds = AebThresholds()
) -> DataFrame:
    """Window of each event: inclusive rows within ``[t-pre, t+post]`` and clip flags.

    The range condition is turned into an equi-join on ``(file_id, time bin)``.
    """
    events = events_from_profile(profile, thresholds)
    want_start = F.col("t_s") - thresholds.window_pre_s
    want_end = F.col("t_s") + thresholds.window_post_s
    wanted = events.withColumn("want_start", want_start).withColumn("want_end", want_end)
    keyed = sg.explode_bins(wanted, F.col("want_start"), F.col("want_end"))
    samples = telemetry.select("file_id", "row", F.col(v.TIMESTAMP).alias("t")).withColumn(
        "tbin", sg.time_bin(F.col("t")))
    inside = samples.join(
        keyed.select("file_id", "tbin", "event_type", "want_start", "want_end"), ["file_id", "tbin"]
    ).filter(F.col("t").between(F.col("want_start"), F.col("want_end")))
    bounds = inside.groupBy("file_id", "event_type").agg(
        F.min("row").alias("start_row"), F.max("row").alias("end_row"),
        F.min_by("t", "row").alias("start_s"), F.max_by("t", "row").alias("end_s"),
    )
    return wanted.join(bounds, ["file_id", "event_type"]).select(
        "file_id",
        window_id(F.col("file_id"), F.col("event_type"), thresholds).alias("window_id"),
        "event_id", "event_type", F.col("t_s").alias("t_event_s"), "start_s", "end_s",
        "start_row", "end_row",
        (F.col("end_row") - F.col("start_row") + 1).alias("sample_count"),
        (F.col("want_start") < F.col("first_t") - EDGE_SLACK_S).alias("clipped_start"),
        (F.col("want_end") > F.col("last_t") + EDGE_SLACK_S).alias("clipped_end"),
    )


def primary_event(profile: DataFrame) -> DataFrame:
    """The event a diagnosis is anchored on: brake command, else TTC crossing, else nothing."""
    braked = F.col("brake_row").isNotNull()
    return profile.withColumn("anchor_t", F.coalesce("brake_t", "crossing_t")).withColumn(
        "anchor_type",
        F.when(braked, F.lit(v.EV_BRAKE)).when(F.col("crossing_row").isNotNull(), F.lit(v.EV_CROSSING)),
    )


def analysis_scope(profile: DataFrame, thresholds: AebThresholds = AebThresholds()) -> DataFrame:
    """Per log: bounds of the primary window (those of the log without one) and the events inside it."""
    p = primary_event(profile)
    lo = F.col("anchor_t") - thresholds.window_pre_s
    hi = F.col("anchor_t") + thresholds.window_post_s
    def inside(name: str, what: str) -> Column:
        ok = F.col("anchor_t").isNull() | F.col(f"{name}_t").between(lo, hi)
        return F.when(ok, F.col(f"{name}_{what}")).alias(f"{name}_{what}")
    return p.select(
        "file_id", "anchor_type",
        F.coalesce(lo, F.col("first_t")).alias("lo_t"), F.coalesce(hi, F.col("last_t")).alias("hi_t"),
        F.when(F.col("anchor_type").isNotNull(),
               window_id(F.col("file_id"), F.col("anchor_type"), thresholds)).alias("window_id"),
        *[inside(n, w) for n in ("brake", "crossing", "collision") for w in ("t", "row")],
    )


def slice_window(telemetry: DataFrame, scope: DataFrame) -> DataFrame:
    """Samples inside the bounds of the scope; its other columns ride along on the same join.

    One binned equi-join for both kinds of log: a window covers two or three time bins, a log
    without an anchor covers all of its own.
    """
    carried = [c for c in scope.columns if c not in ("file_id", "lo_t", "hi_t")]
    keyed = sg.explode_bins(scope, F.col("lo_t"), F.col("hi_t"))
    return (
        telemetry.withColumn("tbin", sg.time_bin(F.col(v.TIMESTAMP)))
        .join(keyed.select("file_id", "tbin", "lo_t", "hi_t", *carried), ["file_id", "tbin"])
        .filter(F.col(v.TIMESTAMP).between(F.col("lo_t"), F.col("hi_t")))
        .drop("tbin", "lo_t", "hi_t")
    )


def events_in_window(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Every (window, event) pair of a log where the event's row lies inside the window."""
    w = windows.select("file_id", "window_id", "start_row", "end_row")
    return events.join(w, "file_id").filter(
        F.col("row").between(F.col("start_row"), F.col("end_row"))
    ).select("file_id", "window_id", "event_id", "event_type", "t_s")


def ttc_series(telemetry: DataFrame, thresholds: AebThresholds = AebThresholds()) -> DataFrame:
    return telemetry.selectExpr(
        "file_id", "row", v.TIMESTAMP,
        f"{ttc(v.GAP, v.REL_V, thresholds.closing_speed_floor_mps)} AS ttc_s")


def rows_in_window(telemetry: DataFrame, windows: DataFrame) -> DataFrame:
    """``file_id, window_id, row`` for every sample of every window.

    Joined on ``(file_id, segment)``: a window names the segments its rows lie in.
    """
    span = F.sequence(sg.segment_of(F.col("start_row")), sg.segment_of(F.col("end_row")))
    keyed = windows.select("file_id", "window_id", "start_row", "end_row", F.explode(span).alias("seg"))
    return (
        telemetry.select("file_id", "row", sg.segment_of(F.col("row")).alias("seg"))
        .join(keyed, ["file_id", "seg"])
        .filter(F.col("row").between(F.col("start_row"), F.col("end_row")))
        .select("file_id", "window_id", "row")
    )
