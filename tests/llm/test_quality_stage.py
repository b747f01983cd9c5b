"""What the fourth review found in the corpus operators."""

from __future__ import annotations

from fleetgauge.llm import quality_rules


def test_kept_rows_are_counted_once(spark, odd, labels, monkeypatch):
    good = " ".join(f"word{i}" for i in range(60))
    docs = odd.unionByName(odd.limit(1).selectExpr("CAST(7 AS BIGINT) AS doc_id", f"'{good}' AS text", "* EXCEPT (doc_id, text)"))
    docs = docs.unionByName(docs.where("doc_id = 7"))
    calls = []
    plain = quality_rules.features
    monkeypatch.setattr(quality_rules, "features", lambda *a: calls.append(a) or plain(*a))
    kept = quality_rules.keep_good(docs, labels)
    assert len(calls) == 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # whole rows were shuffled by stratum
    assert kept.columns == docs.columns and [(r.doc_id, r.text) for r in kept.collect()] == [(7, good), (7, good)]
