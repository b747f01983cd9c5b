"""Registered queries against DuckDB on the smallest tables. ``python check.py`` runs all of them."""

import os

import pytest

import __spark_entry__ as entry
import check

SF_DIR = "/root/testdata/sf0.001"
NAMES = ("gate_results", "null_runs", "metric_braking_latency_s", "chunk_documents", "retrieval_topk",
         "rank_hypotheses", "run_confidence", "approval_decide")


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    ok, info = check.compare(spark, check.connect(SF_DIR), SF_DIR, name)
    assert ok, info
