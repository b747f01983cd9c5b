"""Work that grows with the input in parts: term counts per row, hashed vectors, documents dealt by size."""

import hashlib
import re

from fleetgauge.operators import retrieval
from fleetgauge.plans import fixtures as fx
from fleetgauge.sources import documents as docs
from fleetgauge.sources import telemetry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_in_their_row(spark):
    texts = spark.createDataFrame([(1, "b a b A. b-1"), (2, ""), (3, None), (4, "zz zz")], "key long, text string")
    df = retrieval.term_counts(texts, "key", "text", "n")
    assert "Aggregate" not in _plan(df) and "Exchange" not in _plan(df)
    assert sorted(map(tuple, df.collect())) == [(1, "b-1", 1), (4, "zz", 2)]


def test_terms_of_repeated_and_null_keys_are_added_up(spark):
    texts = spark.createDataFrame([(1, "aa bb aa"), (1, "aa cc"), (None, "dd"), (None, "dd ee"), (2, "aa"), (2, "aa")], "key long, text string")
    got = retrieval.term_counts(texts, "key", "text", "n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, "aa", 3), (1, "bb", 1), (1, "cc", 1), (None, "dd", 2), (None, "ee", 1), (2, "aa", 2)], key=str)


def test_vectors_add_up_the_signs_of_the_hashes(spark):
    rows = [(i, t) for i, t in enumerate(["Red red fox", "", None, "-", "a_1 été b"])]
    df = retrieval.hashed_embedding(spark.createDataFrame(rows, "key long, text string"), "key", "text", 8)
    assert "aggregate(transform(regexp_extract_all" not in _plan(df)  # a list of all buckets was built anew for each token
    got = {r.key: r.vector for r in df.collect()}
    for key, text in rows:
        words, want = re.findall(r"[a-z0-9][a-z0-9_]*", (text or "").lower()), [0] * 8
        for h in (hashlib.sha256(w.encode()).hexdigest() for w in words):
            want[int(h[:8], 16) % 8] += int(h[9], 16) % 2 * 2 - 1
        assert got[key] == (want if words else None)


def test_more_text_is_more_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "TEXT_PART", 100)
    rows = [(i, "x" * 100, "en", "s") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = fx.raw_documents(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() == 40 and docs.count() == 40


def test_lists_of_a_block_are_made_after_one_shuffle(spark):
    rows = [(f"c{i:03}", " ".join(f"w{j}" for j in range(i % 9 + 1))) for i in range(60)]
    indexed, posts = (d.cache() for d in retrieval.build_index(spark.createDataFrame(rows, "chunk_id string, text string")))
    impacts = retrieval.impact_blocks(indexed, posts)
    plan = _plan(impacts)
    assert "collect_list" not in plan and "SortMergeJoin" not in plan
    got = {(r.term, e.chunk_id, e.tf, e.doc_len) for r in impacts.collect() for e in r.entries}
    assert got == {(f"w{j}", f"c{i:03}", 1, i % 9 + 1) for i in range(60) for j in range(i % 9 + 1)}
    assert {r.term: r.n for r in impacts.collect()}["w8"] == 6


def test_lists_are_not_copied_for_each_query(spark):
    rows = [(f"c{i:03}", " ".join(f"w{j}" for j in range(i % 9 + 1))) for i in range(60)]
    impacts = retrieval.impact_blocks(*(d.cache() for d in retrieval.build_index(spark.createDataFrame(rows, "chunk_id string, text string"))))
    queries = spark.createDataFrame([(i, "w1 w2 w3") for i in range(30)], "query_id long, query string")
    top = retrieval.bm25_topk(queries, impacts, 3)
    assert "collect_list(struct(idf, entries" not in _plan(top) and "flatten" not in _plan(top)
    assert sorted((r.query_id, r["rank"]) for r in top.collect()) == [(q, k) for q in range(30) for k in (1, 2, 3)]


def test_a_document_is_written_where_it_stays(spark, tmp_path):
    texts = spark.createDataFrame([(1, "one\ntwo"), (2, None), (3, "a"), (3, "a")], "doc_id long, raw string")
    assert docs.write_documents(texts, "doc_id", "raw", str(tmp_path / "out")) == 3
    files = {p.name: p.read_text() for p in (tmp_path / "out").rglob("*.txt")}
    assert files == {"doc_id=1.txt": "one\ntwo\n", "doc_id=2.txt": "\n", "doc_id=3.txt": "a\na\n"}
    assert {r.file_name: r.raw for r in docs.read_documents(spark, f"{tmp_path}/out/*", "*.txt").collect()} == files


def test_sidecars_are_written_without_a_task_that_moves_them(spark, tmp_path):
    rows = [(f"file_id=f{i}", "sidecar.json", ['{"scenario_id":"S%d","column_units":{"timestamp":"ms"}}' % i]) for i in range(30)]
    assert docs.write_files(spark.createDataFrame(rows, "folder string, name string, lines array<string>"), str(tmp_path)) == 30
    assert len(list(tmp_path.rglob("*"))) == 60  # folders and files, no markers
    read = telemetry.read_sidecars(spark, str(tmp_path), "*.json").collect()
    assert {(r.folder.rsplit("/", 1)[1], r.scenario_id, r.column_units["timestamp"]) for r in read} == {(f"file_id=f{i}", f"S{i}", "ms") for i in range(30)}
