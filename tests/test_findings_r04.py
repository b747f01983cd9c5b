"""What the fourth review found: pairs that were shuffled, and listings the driver held."""

from __future__ import annotations

import random

from fleetgauge.operators import retrieval
from fleetgauge.operators import verification as vf
from fleetgauge.plans import verification_queries
from fleetgauge.session import stored
from fleetgauge.sources import documents as docs
from fleetgauge.sources import listing
from fleetgauge.sources import telemetry as src


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _corpus(spark):
    rng = random.Random(3)
    texts = [(f"c{i:02}", " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 9)))) for i in range(40)]
    rows = [(c, f"{c}.md", 0, t, "manual", "public" if int(c[1:]) % 3 else "restricted", "AEB", None) for c, t in [*texts, texts[5]]]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_name string, ordinal int, text string, source_type string, access_level string, feature string, valid_from date")
    asks = [(i, " ".join(rng.choice("abcdefxy") * 2 for _ in range(4))) for i in range(9)] + [(3, "aa bb"), (None, "cc")]
    return (*(stored(x, "corpus") for x in retrieval.build_index(chunks)), spark.createDataFrame(asks, "query_id long, query string"))


def _by_join(queries, indexed, postings):
    """Scores by joins in plain rows."""
    import math
    chunks = [(r.chunk_id, r.doc_len) for r in indexed.collect()]
    avg = sum(n for _, n in chunks) / len(chunks)
    asked = [(r.query_id, r.term) for r in retrieval.query_terms(queries).collect()]
    posts = [(r.chunk_id, r.term, r.tf) for r in postings.collect()]
    out = {}
    for q, term in asked:
        df = sum(t == term for _, t, _ in posts)
        for c, t, tf in posts:
            for _, n in (x for x in chunks if x[0] == c and t == term):
                idf = math.log(1 + (len(chunks) - df + 0.5) / (df + 0.5))
                out[q, c] = out.get((q, c), 0.0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg))
    return out


def test_scored_pairs_are_not_shuffled(spark, monkeypatch):
    indexed, postings, queries = _corpus(spark)
    for c, q, p in ((8192, 256, 1 << 19), (7, 2, 5)):
        monkeypatch.setattr(retrieval, "CHUNK_BLOCK", c)
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", q)
        monkeypatch.setattr(retrieval, "PAIRS", p)
        scores = retrieval.bm25_score(queries, indexed, postings)
        assert "hashpartitioning(query_id#" not in _plan(scores)
        got = {(r.query_id, r.chunk_id): round(r.score, 9) for r in scores.collect()}
        assert len(got) == scores.count() and got == {k: round(x, 9) for k, x in _by_join(queries, indexed, postings).items()}


def test_scaled_pairs_are_not_shuffled(spark):
    indexed, postings, queries = _corpus(spark)
    candidates = retrieval.access_wall(indexed, ("public",))
    scores = retrieval.bm25_score(queries, indexed, postings)
    want = retrieval.minmax_per_query(scores, "score", "scaled", candidates)
    got = retrieval.minmax_per_query(retrieval.bm25_score(queries, indexed, postings, candidates), "score", "scaled", candidates, listed=True)
    assert "hashpartitioning(query_id#" not in _plan(got)
    rows = sorted((str(r.query_id), r.chunk_id, r.score, r.scaled) for r in got.collect())
    assert rows and rows == sorted((str(r.query_id), r.chunk_id, r.score, r.scaled) for r in want.collect())
    assert {r[1] for r in rows} <= {r.chunk_id for r in candidates.collect()}


def test_tasks_list_what_spark_lists(spark, tmp_path):
    names = ["a/x.txt", "a/deep/y.txt", "p/k=1/z.txt", "b/sp ace%3A é.txt", "b/.h.txt", "b/_h.txt", "b/_h=1.txt", "b/n.csv", "_c/w.txt", "top.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(f"{n}\r\ntext".encode() + b"\xff")
    (tmp_path / "a/empty.txt").write_text("")
    for where, recursive in ((tmp_path, True), (tmp_path / "p", False), (tmp_path / "[ab]", False), (tmp_path / "{a,_c}" / "*", False), (tmp_path / "b", False), (tmp_path / "top.txt", False)):
        options = {"pathGlobFilter": "*.txt"} | ({"recursiveFileLookup": "true"} if recursive else {})
        want = spark.read.text(str(where), wholetext=True, **options).selectExpr("_metadata.file_path AS p", "_metadata.file_name AS f", "hex(value) AS v")
        got = listing.whole_texts(listing.listed_files(spark, str(where), "*.txt", recursive)).selectExpr("source_path AS p", "file_name AS f", "hex(raw) AS v")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), where
    hashed = {r.source_path for r in src.content_hashes(spark, str(tmp_path), "*.txt").collect()}
    assert hashed == {r.path for r in spark.read.format("binaryFile").load(str(tmp_path), pathGlobFilter="*.txt", recursiveFileLookup=True).select("path").collect()}


def test_the_driver_holds_no_file_names(spark, tmp_path):
    for i in range(30):
        (tmp_path / "d" / str(i % 3)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / str(i % 3) / f"{i}.txt").write_text(str(i))
    for df in (docs.read_documents(spark, f"{tmp_path}/d/*", "*.txt"), src.content_hashes(spark, f"{tmp_path}/d", "*.txt")):
        assert df.count() == 30 and not any(str(tmp_path) in f for f in df.inputFiles())


def test_lines_belong_to_the_split_they_begin_in(spark, tmp_path):
    rng = random.Random(5)
    for i in range(6):
        text = "".join(rng.choice(["a", "bc", "é", "\n", "\r", "\r\n", ","]) for _ in range(60))
        (tmp_path / f"{i}.csv").write_bytes((b"\xef\xbb\xbf" if i == 1 else b"") + text.encode() + (b"" if i % 2 else b"end"))
        size = (tmp_path / f"{i}.csv").stat().st_size
        want = [bytes(r.value) for r in spark.read.text(str(tmp_path / f"{i}.csv")).selectExpr("CAST(value AS BINARY) AS value").collect()]
        for step in (1, 2, 3, 7, 1000):
            for block in (1, 2, 5, 1 << 20):
                listing.BLOCK, kept = block, listing.BLOCK
                got = [x for s in range(0, size, step) for part in listing._blocks(f"file:{tmp_path}/{i}.csv", s, min(size, s + step)) for x in part]
                listing.BLOCK = kept
                assert got == want, (i, step, block)


def test_logs_and_sidecars_are_not_listed_by_the_driver(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"file_id={i}").mkdir()
        (tmp_path / f"file_id={i}" / "x.csv").write_text("time,ego_speed\n0,1\n")
        (tmp_path / f"file_id={i}" / "sidecar.json").write_text('[{"scenario_id": "s%d"}, {"scenario_id": "t"}]' % i if i == 2 else '{"scenario_id":\n"s%d"}' % i)
    sidecars = src.read_sidecars(spark, str(tmp_path), "*.json")
    assert sidecars.columns == ["scenario_id", "data_origin", "column_units", "folder"]
    assert sorted(r.scenario_id for r in sidecars.collect()) == ["s0", "s1", "s2", "t"]
    records = src.scan_records(spark, f"{tmp_path}/*").records
    assert records.count() == 3 and not any(str(tmp_path) in f for df in (records, sidecars) for f in df.inputFiles())


def test_rules_resolve_citations_once(spark, monkeypatch):
    calls = []
    plain = vf.resolve_citations
    monkeypatch.setattr(vf, "resolve_citations", lambda *a: calls.append(a) or plain(*a))
    assert verification_queries.applied_rules(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
