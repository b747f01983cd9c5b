import pytest
from helpers import frames, log
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.operators import events as ev
from fleetgauge.operators import faults, gates, metrics, segments
from fleetgauge.policies import QualityPolicy


def _gate(spark, rows, name, policy=QualityPolicy(), **kw):
    tel, files = frames(spark, rows, **kw)
    out = gates.gate_results(gates.quality_profile(tel, files, policy), policy, {name: gates.GATES[name]})
    return out.first()


def test_half_second_gap_warns(spark):
    tel, files = frames(spark, log(drop=[(2.0, 2.5)]))
    profile = gates.quality_profile(tel, files)
    assert gates.gate_results(profile, gates={"t": gates.gate_timestamps}).first()["status"] == "warn"
    gap = gates.timestamp_gaps(tel).first()
    assert (round(gap["start_s"], 6), round(gap["end_s"], 6), gap["missing_samples"]) == (1.98, 2.5, 25)
    assert profile.first()["missing_time_s"] == pytest.approx(0.5)


def test_long_gap_fails_and_policy_changes_it(spark):
    assert _gate(spark, log(drop=[(3.0, 7.0)]), "timestamp_continuity")["status"] == "fail"
    gap = log(drop=[(2.0, 2.5)])
    assert _gate(spark, gap, "timestamp_continuity", QualityPolicy(max_missing_time_fraction=0.01))["status"] == "fail"
    assert _gate(spark, gap, "timestamp_continuity", QualityPolicy(gap_factor=100.0))["status"] == "pass"


def test_swapped_rows(spark):
    def swap(r, x):
        x["t"] = {100: 101 * 0.02, 101: 100 * 0.02}.get(r, x["t"])
    tel, _ = frames(spark, log(change=swap))
    assert [r["row"] for r in gates.first_failing_rows(tel).collect()] == [101]


def test_null_burst(spark):
    tel, files = frames(spark, log())
    burst = faults.nan_burst(tel, v.CONF, 5.0, 0.2)
    run = gates.null_runs(burst, files).first()
    assert (run["signal"], round(run["start_s"], 6), round(run["end_s"], 6), run["samples"]) == (
        "object_confidence", 5.0, 5.18, 10)
    count = gates.missing_value_counts(gates.quality_profile(burst, files)).first()
    assert (count["count"], count["fraction"]) == (10, 0.02)


def test_value_ranges(spark):
    def bad(r, x):
        if r == 10:
            x.update(brake=2.0, conf=1.5, speed=-1.0)
    result = _gate(spark, log(change=bad), "value_ranges")
    assert result["status"] == "fail"
    assert result["message"] == (
        "out-of-range values: ego_speed_mps (1), object_confidence (1), brake_command (1)")


def test_absent_is_not_all_null(spark):
    without = tuple(s for s in v.SIGNALS if s != v.CONF)
    def nulled(r, x):
        x["conf"] = None
    assert _gate(spark, log(change=nulled), "required_signals", present=without)["status"] == "fail"
    assert _gate(spark, log(change=nulled), "missing_values", present=without)["status"] == "pass"
    assert _gate(spark, log(change=nulled), "missing_values")["status"] == "fail"


def test_no_events_reasons(spark):
    tel, files = frames(spark, log(brake_at=None, closing=False))
    a = metrics.Analysis(tel, files, metrics.log_profile(tel, files))
    rows = {r["name"]: r for r in a.metrics.collect()}
    assert a.events.count() == 0
    assert {r["window_id"] for r in rows.values()} == {None}
    assert rows[v.M_MIN_TTC]["missing_reason"] == "ego never closes on the lead"
    assert rows[v.M_CROSSING]["missing_reason"] == "TTC never fell to 2.0 s"
    assert rows[v.M_LATENCY]["missing_reason"] == "no brake command"
    assert rows[v.M_DROPOUT]["missing_reason"] == "no TTC threshold crossing"


def test_ttc_definition(spark):
    df = spark.createDataFrame([(20.0, -10.0), (20.0, 0.0), (20.0, 5.0), (0.0, -10.0)], "g double, r double")
    from fleetgauge.functions.kinematics import ttc
    assert [r["x"] for r in df.select(F.expr(ttc("g", "r", 0.5)).alias("x")).collect()] == [2.0, None, None, 0.0]


def test_segments_do_not_change_results(spark, monkeypatch):
    """Cutting a log into tiny segments gives the same intervals, runs, timing and metrics."""
    def holes(r, x):
        if 95 <= r < 140 or r in (10, 499):
            x["accel"] = None
        if r in (63, 64, 65, 128):
            x["t"] = x["t"]
    tel, files = frames(spark, log(n=700, change=holes), log("file_b", n=90, brake_at=None, closing=False))
    tel = tel.cache()
    profile = metrics.log_profile(tel, files)

    def everything():
        a = metrics.Analysis(tel, files, profile)
        # slices of whole and anchored logs, neighbours across edges
        return (
            sorted(map(tuple, gates.sample_intervals(tel).collect())),
            sorted(map(tuple, gates.null_runs(tel, files).collect())),
            sorted(map(tuple, gates.file_timing(tel).collect())),
            sorted(map(str, a.metrics.select("file_id", "name", F.round("value", 9), "t_s").collect())),
            sorted(map(tuple, faults.timestamp_gap(tel.select("file_id", "row", v.TIMESTAMP), 1.0, 0.5).collect())),
        )

    whole = everything()
    monkeypatch.setattr(segments, "SEGMENT_ROWS", 32)
    monkeypatch.setattr(segments.with_halo, "__defaults__", (32,))
    monkeypatch.setattr(segments.segment_of, "__defaults__", (32,))
    assert everything() == whole


def test_exact_median_against_brute_force(spark):
    import random
    import statistics
    rng = random.Random(5)
    data = [("k1" if rng.random() < 0.9 else "k2", rng.choice([0.02, rng.random(), rng.random() * 1e-7])) for _ in range(2001)]
    counts = spark.createDataFrame(data, "file_id string, dt double").groupBy("file_id", "dt").agg(F.count("*").alias("n"))
    got = {r["file_id"]: r["m"] for r in segments.exact_median(counts, "file_id", "dt", "n", "m").collect()}
    for k in ("k1", "k2"):
        assert got[k] == pytest.approx(statistics.median(x for f, x in data if f == k), abs=0)


def test_ranked_equals_row_number(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "(id * 7919) % 1000 as x")
    got = segments.ranked(df, ["k"], [F.col("x")], F.floor(F.col("x") / 50), "r").collect()
    for k in range(3):
        rows = sorted((r["x"], r["r"]) for r in got if r["k"] == k)
        assert [r for _, r in rows] == list(range(len(rows)))
