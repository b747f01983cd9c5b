"""Cases found in review: type suffixes, emptied buckets, map order, several approvals, conflicting headers."""

import pytest
from helpers import frames, log
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.operators import evaluation, ingest, metrics, reports, verification
from fleetgauge.sources import tables
from fleetgauge.sources.reports import write_report_documents


def test_type_suffixes_and_hex_floats_are_not_numbers(spark):
    headers = spark.createDataFrame([("f", ["timestamp_s", "ego_speed_mps"])], "file_id string, header array<string>").withColumn(
        "declared", F.expr("cast(map() as map<string,string>)"))
    cells = ["1.0d", "2f", "0x1p3", "1.5", "-2e3", " 7 ", ".5", "3."]
    rows = spark.createDataFrame([("f", i, [str(i), c]) for i, c in enumerate(cells)], "file_id string, row long, fields array<string>")
    out = ingest.normalise(rows, ingest.file_layout(ingest.resolve_columns(headers)), ["file_id"])
    assert [r[v.SPEED] for r in out.orderBy("row").collect()] == [None, None, None, 1.5, -2000.0, 7.0, 0.5, 3.0]
    assert ingest.coerced_counts(out).first()["coerced"] == 3


def test_logs_with_conflicting_headers_are_refused(spark):
    headers = spark.createDataFrame(
        [("bad", ["timestamp_s", "ego_speed_kmh", "ego_speed_mps"]), ("good", ["timestamp_s", "ego_speed_mps"])],
        "file_id string, header array<string>").withColumn("declared", F.expr("cast(map() as map<string,string>)"))
    resolved = ingest.resolve_columns(headers)
    assert [r.file_id for r in ingest.file_layout(resolved).collect()] == ["good"]
    assert [r.file_id for r in ingest.provenance_of(resolved, headers.select("file_id")).collect()] == ["good"]
    assert [r.file_id for r in ingest.header_conflicts(resolved).collect()] == ["bad"]


def test_emptied_bucket_loses_its_rows(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "file_id string, value double")
    tables.upsert_by_file(rows, path, rows.select("file_id"), buckets=64)
    tables.upsert_by_file(rows.limit(0), path, rows.where("file_id = 'a'").select("file_id"), buckets=64)
    assert [r.file_id for r in spark.read.parquet(path).collect()] == ["b"]


def test_fingerprint_ignores_the_order_of_maps(spark):
    a = spark.sql("SELECT 'c' AS case_id, map('a', 1, 'b', 2) AS m")
    b = spark.sql("SELECT 'c' AS case_id, map('b', 2, 'a', 1) AS m")
    c = spark.sql("SELECT 'c' AS case_id, map('b', 1, 'a', 2) AS m")
    prints = [evaluation.suite_fingerprint(x).first()["suite_sha256"] for x in (a, b, c)]
    assert prints[0] == prints[1] != prints[2]


def test_first_approval_of_a_report_counts(spark):
    report = spark.createDataFrame([("r",)], "report_id string")
    approvals = spark.createDataFrame([("a2", "r", 1), ("a1", "r", 2)], "approval_id string, report_id string, created_at int")
    decided = spark.createDataFrame([("a1", "rejected", 1, "applied")], "approval_id string, decision string, decided_at int, outcome string")
    rows = reports.reports_with_approval(report, approvals, decided).collect()
    assert [(r.approval_id, r.status) for r in rows] == [("a2", "pending_review")]


def test_refusal_lists_all_unknown_ids(spark, tmp_path):
    ids = [f"metric_{i:012d}" for i in range(9)]
    documents = spark.createDataFrame([("report_ab", "f", " ".join(ids))], "report_id string, file_id string, document string")
    none = spark.createDataFrame([], "key string, file_id string, evidence_id string")
    path = str(tmp_path / "reports")
    with pytest.raises(ValueError, match="9 unknown"):
        write_report_documents(documents, none, none, path)
    assert spark.read.parquet(f"{path}__unknown_ids").count() == 9


GOOD = '{"cause": "late braking", "confidence": 0.5, "evidence_ids": ["metric_1"]}'
ANSWERS = {
    '{"hypotheses": [%s]}' % GOOD: True,
    '{"hypotheses": [{"cause": "c", "confidence": 1}], "observations": [], "missing_evidence": ["x"]}': True,
    '```json\n{"observations": ["a"]}\n```': True,
    '{"observations": null}': False,
    '{"observations": [1, 2]}': False,
    '{"observations": [{"a": 1}]}': False,
    '{"observations": ["a", null]}': False,
    '{"hypotheses": null}': False,
    '{"hypotheses": [{"cause": "c", "confidence": 0.5, "failure_class": null}]}': False,
    '{"hypotheses": [{"cause": "c", "confidence": 0.5, "evidence_ids": null}]}': False,
    '{"hypotheses": [{"cause": "c", "confidence": "0.5"}]}': False,
    "{'observations': ['a']}": False,
    '{"observations": ["a"]} and {"hypotheses": [}': False,
    '{"observations": ["a"]} {"observations": ["b"]}': False,
    '{"observations": ["a"]}, {"observations": ["b"]}': False,
    '{"observations": ["a"]}] {}': False,
    '{"observations": ["a"]}} {}': False,
}


def test_answers_of_another_shape_are_rejected(spark):
    raw = spark.createDataFrame([(str(i), t) for i, t in enumerate(ANSWERS)], "run_id string, raw string")
    accepted = {r.run_id: r.rejected is None for r in verification.parse_agent_outputs(raw).collect()}
    assert {t: accepted[str(i)] for i, t in enumerate(ANSWERS)} == ANSWERS


def test_nan_samples_are_missing_ones(spark):
    def change(r, x):
        if 100 <= r < 130:
            x["conf"], x["speed"] = float("nan"), float("nan")

    row = metrics.log_profile(*frames(spark, log(change=change))).first()
    assert row[f"null_{v.CONF}"] == row[f"null_{v.SPEED}"] == 30 and row[f"bad_{v.CONF}"] == row[f"bad_{v.SPEED}"] == 0
