"""Line dedup runs on DataFrame functions alone; its search of large buckets equals comparing all lines."""

import random

import pytest

from fleetgauge.llm import line_dedup

DOC = "doc_id long, text string"


def components(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_no_python_runs_on_executors(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the same long line of text\nanother"), (2, "the same long line of text!"), (3, "é\nother words")], DOC)

    def refused(*_args, **_kwargs):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, refused)
    got = {r.doc_id: (r.text, r._removed) for r in line_dedup.dedup(docs).collect()}
    assert got == {1: ("the same long line of text\nanother", 0), 2: ("", 1), 3: ("é\nother words", 0)}


@pytest.mark.parametrize("chunk", [1 << 21, 1 << 10])
def test_search_of_a_large_bucket_equals_comparing_all(spark, chunk, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdéfgh ") for _ in range(90))
    lines = {base}
    for n in (2, 6, 9, 12, 20, 40):
        lines |= {base[:-n] + "".join(rng.choice("xyz𝒳uvw") for _ in range(n + rng.randint(0, 3))) for _ in range(12)}
    lines |= {x[:-1] + "!" for x in sorted(lines)[::5]} | {"short", "shorter", "a"}
    rows = list(enumerate(sorted(lines)))
    table = spark.createDataFrame(rows, "node long, line string")
    members = spark.createDataFrame([(7, i, len(rows), sum(map(len, lines))) for i, _ in rows], "bucket long, node long, n long, bytes long")
    links = [(r.a, r.b) for r in line_dedup.searched(members, table).collect()]
    sets = [frozenset(x[i:i + 8] for i in range(max(1, len(x) - 7))) for _, x in rows]
    want = line_dedup._few(sets, [False] * len(sets))
    assert components(range(len(rows)), links) == components(range(len(rows)), want)
    assert 5 < len(set(components(range(len(rows)), want).values())) < len(rows) - 5
