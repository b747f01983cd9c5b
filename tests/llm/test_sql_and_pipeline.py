"""Registered queries against SQL, and the pipeline against the operators' brute-force parts."""

import hashlib
import math
import os
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from fleetgauge.llm import mixing, oracle, queries
from fleetgauge.session import stored

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def rows_of_sql(sql):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF_DIR)) == rows_of_sql(queries.ORACLE[name])


@pytest.mark.parametrize("block, frame", [(1, 40), (2, 30)])
def test_mix_matches_sql_over_many_frames(spark, block, frame, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "FRAME", frame)
    assert rows_of(queries.op4_mixing(spark, SF_DIR)) == rows_of_sql(oracle.mixing())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    verdicts = {r.doc_id: r.kept for r in queries.op5_quality_rules(spark, SF_DIR).collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        if name == "quality_rules":
            assert set(ids) == {i for i, k in verdicts.items() if k}
        elif name == "simhash":
            assert 0 < len(ids) <= len(before)
        else:
            assert set(ids) == before
        assert name == "sentencepiece" or docs.columns == columns
    assert docs.where("NOT restored").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").collect()) == sorted(ids)


def brute_force_slots(rows, block, frame):
    """(slot, place) of each (doc_id, source): whole frames while a source fills them, then one closing frame."""
    by = defaultdict(list)
    for i, source in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        by["null" if source is None else "=" + source].append(i)
    names = sorted(by)
    roots = sum(math.sqrt(len(by[k])) for k in names)
    quota = {k: max(1, math.floor(frame * math.sqrt(len(by[k])) / roots + 0.5)) for k in names}
    whole = {k: len(by[k]) // block // quota[k] for k in names}
    blocks = {k: [by[k][i:i + block] for i in range(0, len(by[k]), block)] for k in names}
    plan = [{k: quota[k] for k in names if whole[k] > f} for f in range(max(whole.values()))]
    plan.append({k: r for k in names if (r := len(blocks[k]) - quota[k] * whole[k])})
    out, at, slot = {}, dict.fromkeys(names, 0), 0
    for part in plan:
        size, done = sum(part.values()), dict.fromkeys(part, 0)
        for t in range(size):
            ready = [k for k in part if done[k] < part[k] and done[k] * size <= t * part[k]]
            pick = min(ready, key=lambda k: (-(-(done[k] + 1) * size // part[k]), k))
            out |= {i: (slot, n) for n, i in enumerate(blocks[pick][at[pick]])}
            done[pick] += 1
            at[pick] += 1
            slot += 1
    return out


def test_pipeline_carries_the_mix_over_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 2)
    monkeypatch.setattr(mixing, "FRAME", 30)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(5).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "slot", "place").collect()
    want = brute_force_slots([(r.doc_id, r.source) for r in rows], 2, 30)
    assert len(rows) > 30 and {r.doc_id: (r.slot, r.place) for r in rows} == want
