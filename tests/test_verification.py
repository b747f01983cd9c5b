import pytest

from fleetgauge.operators import verification as vf
from fleetgauge.sources import tables

REGISTRY = [
    ("metric_1", "metric", "telemetry", 1.0, False, False, False), ("metric_2", "metric", "telemetry", 2.0, True, False, False),
    ("event_1", "event", "telemetry", 1.5, None, False, False), ("chunk_1", "chunk", "doc:requirement", None, None, False, False),
    ("chunk_2", "chunk", "doc:issue", None, None, True, True), ("file_1", "file", "file", None, None, False, False),
]


def _verify(spark, *hyps):
    """hyps: (cause, failure_class, confidence, [ids])"""
    registry = spark.createDataFrame(
        REGISTRY, "evidence_id string, kind string, source string, t_s double, passed boolean, stale boolean, injection_flagged boolean")
    h = spark.createDataFrame([("run_1", i, i, c, k, s) for i, (c, k, s, _) in enumerate(hyps)],
                              "run_id string, hypothesis_index long, hyp_key long, cause string, failure_class string, confidence double")
    cites = [(i, p, e) for i, (*_, ids) in enumerate(hyps) for p, e in enumerate(ids)] or [(-1, 0, "none")]
    c = spark.createDataFrame(cites, "hyp_key long, pos long, evidence_id string")
    return vf.verify_hypotheses(h, vf.resolve_citations(c, registry))


def _runs(spark, verdict="pass", missing=(), origin="unknown"):
    return spark.createDataFrame(
        [("run_1", "quality_1", verdict, "size", origin, list(missing), [], 0)],
        "run_id string, quality_id string, quality_verdict string, warned_gates string, data_origin string, missing array<string>, "
        "observations array<string>, excluded_by_access int")


def test_stripping(spark):
    out = _verify(spark, ("a", "unknown", 0.9, ["nope"]), ("b", "unknown", 0.9, ["chunk_1"]), ("c", "unknown", 0.9, ["file_1"]),
                  ("d", "unknown", 0.9, []), ("e", "unknown", 0.9, ["metric_1", "chunk_1", "event_1", "gone"]))
    rows = {r["cause"]: r for r in out.collect()}
    assert [rows[x]["reason"] for x in "abcd"] == [
        "none of the cited evidence IDs resolve", "no timestamped evidence for a root cause",
        "no timestamped evidence for a root cause", "no evidence cited"]
    assert rows["e"]["status"] == "partial" and rows["e"]["sources"] == ["telemetry", "doc:requirement"]
    run = vf.run_verdicts(_runs(spark), out).first()
    assert run["unsupported_claim_rate"] == pytest.approx(0.8)
    assert (run["cited_total"], run["cited_resolved"]) == (7, 5)


@pytest.mark.parametrize("ids,confidence,expected,label", [
    (["metric_1", "event_1"], 0.95, 0.6, "medium"), (["metric_2", "chunk_1"], 0.8, 0.65, "medium"),
    (["metric_1", "chunk_2"], 0.9, 0.6, "medium"), (["metric_1", "chunk_1"], 0.7, 0.7, "high"),
    (["metric_1", "chunk_1"], 0.39, 0.39, "low")])
def test_adjustment(spark, ids, confidence, expected, label):
    row = _verify(spark, ("a", "unknown", confidence, ids)).first()
    assert (row["adjusted"], row["label"]) == (expected, label)


def test_run_rules(spark):
    two = _verify(spark, ("a", "fusion_error", 0.8, ["metric_1", "chunk_1"]), ("b", "control_issue", 0.75, ["metric_1", "chunk_1"]))
    assert vf.run_verdicts(_runs(spark), two).first()["human_review_required"]
    same = _verify(spark, ("a", "fusion_error", 0.8, ["metric_1", "chunk_1"]), ("b", "fusion_error", 0.75, ["metric_1", "chunk_1"]))
    assert not vf.run_verdicts(_runs(spark), same).first()["human_review_required"]
    def level(*args, **kw):
        return vf.run_verdicts(_runs(spark, *args, **kw), same).first()["report_confidence"]
    assert [level(), level("degraded"), level("blocked"), level(missing=["min_ttc_s: x"])] == ["high", "medium", "blocked", "low"]


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "file_id string, value int")
    tables.upsert_by_file(rows(("a", 1), ("b", 2)), path, rows(("a", 0), ("b", 0)), 4)
    for _ in range(2):
        tables.upsert_by_file(rows(("a", 5)), path, rows(("a", 0)), 4)
    assert sorted((r["file_id"], r["value"]) for r in spark.read.parquet(path).collect()) == [("a", 5), ("b", 2)]


def test_every_offending_text_is_listed_whole(spark):
    long = "seen on-road " + "x" * 300
    out = _verify(spark, (long, "unknown", 0.9, ["metric_1", "chunk_1"]), ("plain", "unknown", 0.8, ["metric_1"]), ("on-road again", "unknown", 0.1, []))
    runs = _runs(spark, origin="synthetic").drop("observations").selectExpr("*", "array('fine', 'also on-road') AS observations")
    got = {r.wording for r in vf.offending_texts(runs, out).collect()}
    assert got == {long, "also on-road"}
    rules = vf.run_rules(vf.run_verdicts(_runs(spark, "blocked"), out), vf.offending_texts(runs, out)).collect()
    assert {r.detail for r in rules if r.rule == "quality_blocked"} == {"quality_1"}
    assert sum(r.rule == "synthetic_no_real_world_claims" for r in rules) == 2


def test_only_decision_values_decide(spark):
    from fleetgauge.operators import reports as rp

    rows = [("a", 1, 1, "deferred", "r", ""), ("a", 2, 2, "approved", "s", "ok"), ("a", 3, 3, "rejected", "t", ""), ("b", 4, 1, "later", "r", ""), ("b", 5, 2, None, "r", "")]
    decided = rp.decide_approvals(spark.createDataFrame(rows, "approval_id string, event_id int, decided_at int, decision string, reviewer string, reason string"))
    assert {r.event_id: r.outcome for r in decided.collect()} == {1: "refused", 2: "applied", 3: "conflict", 4: "refused", 5: "refused"}
    tasks = spark.createDataFrame([("a", "pending_review"), ("b", "pending_review")], "approval_id string, status string")
    assert {r.approval_id: (r.status, r.reviewer, r.reason) for r in rp.decided_approvals(tasks, decided).collect()} == {
        "a": ("approved", "s", "ok"), "b": ("pending_review", None, None)}
