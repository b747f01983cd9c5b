"""What the third review found: memory that followed the input, and postings read more often than needed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetgauge.operators import retrieval
from fleetgauge.operators import verification as vf
from fleetgauge.plans import fixtures as fx
from fleetgauge.session import stored


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_more_citations_are_more_parts(spark, monkeypatch):
    cited = [(h, "a" if i % 2 else None, i) for h in range(3) for i in range(5)]
    cites = spark.createDataFrame(cited, "hyp_key long, evidence_id string, pos long")
    registry = spark.createDataFrame([("a", "metric", "telemetry", 1.0, True, False, False)],
                                     "evidence_id string, kind string, source string, t_s double, passed boolean, stale boolean, injection_flagged boolean")
    monkeypatch.setattr(vf, "PART_ROWS", 2)
    found = vf.resolve_citations(cites, registry)
    assert "hashpartitioning(hyp_key#" in _plan(found) and "evidence_id#" in _plan(found) and ", 8), REPARTITION_BY_NUM" in _plan(found)
    got = {(r.hyp_key, r.evidence_id): (r.pos, r.resolved) for r in found.collect()}
    assert got == {(h, e): (p, bool(e)) for h in range(3) for e, p in (("a", 1), (None, 0))}
    assert vf.resolve_citations(cites.limit(0), registry).count() == 0


def _corpus(spark):
    texts = [("c1", "red fox red"), ("c2", "blue fox"), ("c3", "green")]
    chunks = spark.createDataFrame([(c, f"{c}.md", 0, t, "manual", "public", "AEB", None) for c, t in texts],
                                   "chunk_id string, file_name string, ordinal int, text string, source_type string, access_level string, feature string, valid_from date")
    queries = spark.createDataFrame([(1, "red fox fox"), (2, "blue"), (3, "-"), (4, "fox")], "query_id long, query string")
    return (*(stored(x, "corpus") for x in retrieval.build_index(chunks)), queries)


def test_pairs_are_counted_where_they_arise(spark, monkeypatch):
    indexed, postings, queries = _corpus(spark)
    monkeypatch.setattr(retrieval, "PAIRS", 4)
    df = retrieval.shared_terms(queries, indexed, postings)
    assert "hashpartitioning(chunk_id#" in _plan(df) and ", 3), REPARTITION_BY_NUM" in _plan(df)
    assert "hashpartitioning(query_id#" not in _plan(df)  # pairs were shuffled
    assert sorted(map(tuple, df.collect())) == [(1, "c1", 2, 3), (1, "c2", 1, 1), (2, "c2", 1, 1), (4, "c1", 1, 1), (4, "c2", 1, 1)]


def test_retrieval_reads_postings_once(spark, monkeypatch):
    indexed, postings, queries = _corpus(spark)
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    counted = postings.mapInArrow(seen, postings.schema)
    kept = {}
    monkeypatch.setattr(retrieval, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    found = retrieval.hybrid_retrieve(indexed, counted, queries, today=dt.date(2026, 6, 1)).collect()
    assert reads.value == postings.count()
    # terms of chunks that are no candidates count for the weights all the same
    assert sorted((r.chunk_id, sorted((h.term, h.tf) for h in r.hits)) for r in kept["chunk-hits"].collect()) == [
        ("c1", [("fox", 1), ("red", 2)]), ("c2", [("blue", 1), ("fox", 1)])]
    assert {(r.query_id, r.chunk_id) for r in found if r.rank == 1} >= {(1, "c1"), (2, "c2")} and len(found) == 12


def test_index_cuts_documents_into_chunks_once(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "red fox", "en", "web", 7), (2, "blue", "en", "web", 4)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    monkeypatch.setattr(retrieval, "stored", lambda df, name: kept.append(name) or stored(df, name))
    indexed, postings = fx.index(spark, str(tmp_path))
    assert kept == ["repeated-keys"]  # looked up for the stored chunks only, not for chunks cut anew
    assert {(r.chunk_id, r.doc_len) for r in indexed.collect()} == {
        (r.chunk_id, r.n) for r in postings.groupBy("chunk_id").agg(F.sum("tf").alias("n")).collect()}
