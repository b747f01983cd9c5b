"""Exact top-k over impact blocks, block joins, vectors of a model."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import retrieval
from fleetgauge.policies import RetrievalFilters
from fleetgauge.sources import documents as src

TODAY = dt.date(2026, 6, 1)
CHUNKS = ("chunk_id string, file_name string, ordinal int, text string, source_type string, feature string, valid_from date, access_level string")


def _chunks(spark, n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    rows = [(f"chunk_{i:05}", f"doc_{i % 7}.md", i, " ".join(rng.choices(words, weights, k=rng.randint(0, 30))), rng.choice(["manual", "requirement"]),
             "AEB", TODAY, rng.choice(["public", "internal", "restricted"])) for i in range(n)]
    return spark.createDataFrame(rows, CHUNKS)


@pytest.fixture(scope="module")
def index(spark):
    indexed, posts = retrieval.build_index(_chunks(spark, 400))
    return indexed.cache(), posts.cache()


@pytest.mark.parametrize("block, first", [(16, 1), (60, 2), (1024, 2)])
def test_topk_equals_all_scores(spark, index, monkeypatch, block, first):
    monkeypatch.setattr(retrieval, "IMPACT_BLOCK", block)
    monkeypatch.setattr(retrieval, "FIRST_BLOCKS", first)
    queries = spark.createDataFrame([("q" + str(i), " ".join(f"w{j}" for j in q)) for i, q in enumerate(
        [(0,), (1, 2, 39), (30, 31, 32), (0, 0, 5), (99,), ()])], "query_id string, query string")
    got = sorted(tuple(r) for r in retrieval.bm25_topk(queries, retrieval.impact_blocks(*index), 7).collect())
    every = {}
    for r in retrieval.bm25_score(queries, *index).collect():
        every.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    want = sorted((q, i + 1, c, -s) for q, rows in every.items() for i, (s, c) in enumerate(sorted(rows)[:7]))
    assert got == want


def test_no_pairs_of_queries_and_chunks_in_the_plan_of_topk(spark, index):
    queries = spark.createDataFrame([(1, "w1 w2")], "query_id long, query string")
    plan = retrieval.bm25_topk(queries, retrieval.impact_blocks(*index), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(entries" not in plan


@pytest.mark.parametrize("dim, query_block, chunk_block", [(3, 2, 50), (7, 256, 8192)])
def test_blocks_and_vectors_of_a_model(spark, tmp_path, monkeypatch, dim, query_block, chunk_block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", chunk_block)
    rng = np.random.default_rng(dim)
    chunks = _chunks(spark, 120, seed=dim)
    ids = sorted(r.chunk_id for r in chunks.collect())
    vectors = spark.createDataFrame([(c, rng.normal(size=dim).tolist()) for c in ids[:-1]], "chunk_id string, vector array<double>")
    indexed, posts = retrieval.build_index(chunks, vectors)
    src.write_index(indexed, posts, str(tmp_path / "ix"), "model", "m")
    indexed, posts = src.read_index(spark, str(tmp_path / "ix"), "model")
    asked = [(f"run {i}", f"w{i} w{2 * i + 3}", rng.normal(size=dim).tolist()) for i in range(5)] + [("none", "zzz", None)]
    queries = spark.createDataFrame(asked, "query_id string, query string, vector array<double>")
    rows = indexed.where("access_level <> 'restricted'").collect()
    every = indexed.collect()
    got = sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in retrieval.hybrid_retrieve(
        indexed, posts, queries, today=TODAY, filters=RetrievalFilters(allowed_access=("public", "internal")), top_k=4).collect())
    # extremes are over the chunks behind the wall, statistics over all
    assert got == _plain_behind_wall(every, rows, asked, 4)


def _plain_behind_wall(every, allowed, queries, top_k):
    import re
    from math import log

    toks = {r.chunk_id: re.findall(r"w[0-9]+", r.text) for r in every}
    n, avg = len(every), sum(map(len, toks.values())) / len(every)
    df = {}
    for words in toks.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    unit = lambda x: None if x is None else np.array(x) / (np.linalg.norm(x) or 1)
    out = []
    for qid, text, vec in queries:
        cos, kw = [], []
        for r in allowed:
            words = toks[r.chunk_id]
            kw.append(sum(round(log(1 + (n - df[t] + .5) / (df[t] + .5)) * words.count(t) * 2.5 / (words.count(t) + 1.5 * (.25 + .75 * len(words) / avg)) * 1e12)
                          for t in set(re.findall(r"w[0-9]+", text)) if t in df) / 1e12)
            cos.append(float(unit(vec) @ unit(r.vector)) if vec and r.vector else 0.0)
        scale = lambda x, s: (0.0 if max(s) <= 0 else 1.0) if max(s) - min(s) < 1e-12 else (x - min(s)) / (max(s) - min(s))
        final = [(.6 * scale(c, cos) + .4 * scale(k, kw) + .1 * {"manual": .85, "requirement": 1.0}[r.source_type], r) for r, c, k in zip(allowed, cos, kw)]
        final.sort(key=lambda s: (-s[0], s[1].file_name, s[1].ordinal))
        out += [(qid, i + 1, s[1].chunk_id, round(s[0], 6)) for i, s in enumerate(final[:top_k])]
    return sorted(out)


def test_vectors_of_two_lengths_stop(spark, index):
    queries = spark.createDataFrame([("q", "w1", [1.0, 2.0])], "query_id string, query string, vector array<double>")
    with pytest.raises(Exception, match="dimensions differ"):
        retrieval.hybrid_retrieve(*index, queries, today=TODAY).collect()


def test_vector_of_a_row_needs_no_shuffle(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "key long, text string")
    df = retrieval.hashed_embedding(texts, "key", "text")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    rows = {r.key: r for r in df.collect()}
    assert sum(map(abs, rows[1].vector)) in (1, 3) and len(rows[1].vector) == 32 and rows[2].vector is None and rows[3].vector is None


def test_candidates_without_a_match_count_among_the_extremes(spark):
    scores = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (1, "hidden", 9.0)], "query_id long, chunk_id string, score double")
    candidates = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_id string")
    got = {r.chunk_id: r.x for r in retrieval.minmax_per_query(scores, "score", "x", candidates).collect()}
    assert got == {"a": 0.5, "b": 1.0}
    assert retrieval.minmax_per_query(scores, "score", "x", candidates.where(F.col("chunk_id") != "c")).where("chunk_id = 'a'").first().x == 0.0
