"""Registry per log."""

import pytest

from fleetgauge.operators import diagnosis as dg
from fleetgauge.operators import verification as vf

ITEM = "file_id string, evidence_id string, kind string, summary string, t_s double, passed boolean"


def _registry(spark, rows):
    items = spark.createDataFrame(rows, ITEM)
    sources = spark.createDataFrame([("a", "chunk_1", "manual", True)], "file_id string, evidence_id string, source_type string, stale boolean")
    flags = spark.createDataFrame([("b", "chunk_1")], "file_id string, evidence_id string")
    return vf.evidence_registry(items, sources, flags, dg.SCOPE)


def test_an_id_of_another_log_does_not_resolve(spark):
    registry = _registry(spark, [("a", "metric_1", "metric", "", 1.0, True), ("b", "metric_2", "metric", "", None, None),
                                 ("a", "chunk_1", "chunk", "", None, None), ("b", "chunk_1", "chunk", "", None, None)])
    rows = {(r.file_id, r.evidence_id): r for r in registry.collect()}
    assert len(rows) == 4
    assert (rows["a", "chunk_1"].source, rows["a", "chunk_1"].stale, rows["a", "chunk_1"].injection_flagged) == ("doc:manual", True, False)
    assert (rows["b", "chunk_1"].source, rows["b", "chunk_1"].stale, rows["b", "chunk_1"].injection_flagged) == ("doc:unknown", False, True)
    cites = spark.createDataFrame([("h", "a", 0, "metric_1"), ("h", "a", 1, "metric_2"), ("h", "a", 2, "metric_1")],
                                  "hyp_key string, file_id string, pos int, evidence_id string")
    got = {r.evidence_id: (r.resolved, r.pos) for r in vf.resolve_citations(cites, registry, dg.SCOPE).collect()}
    assert got == {"metric_1": (True, 0), "metric_2": (False, 1)}
    hyps = spark.createDataFrame([("h", "run")], "hyp_key string, run_id string")
    assert [tuple(r) for r in vf.unresolved_ids(hyps, cites, registry, dg.SCOPE).collect()] == [("run", "metric_2")]


def test_a_duplicate_stops_the_write(spark, tmp_path):
    twice = _registry(spark, [("a", "metric_1", "metric", "", 1.0, True)] * 2)
    with pytest.raises(ValueError, match="duplicate evidence ids: a/metric_1"):
        dg.publish_registry(twice, str(tmp_path / "registry"))
    assert not (tmp_path / "registry").exists()
    dg.publish_registry(_registry(spark, [("a", "m", "metric", "", 1.0, True), ("b", "m", "metric", "", 1.0, True)]), str(tmp_path / "registry"))
    assert spark.read.parquet(str(tmp_path / "registry")).count() == 2
