"""Cell search against all cosines."""

import numpy as np
import pytest

from fleetgauge.operators import cells


@pytest.mark.parametrize("dim, n_cells, block", [(3, 8, 20), (16, 4, 8192)])
def test_nearest_equals_all_cosines(spark, tmp_path, monkeypatch, dim, n_cells, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "QUERIES", 5)
    rng = np.random.default_rng(dim)
    x = np.repeat(rng.normal(size=(40, dim)), 6, axis=0) + rng.normal(size=(240, dim)) * 0.05
    x[100:160] = x[100]  # many equal vectors: ties, and a cell of more than one block
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * dim), (902, [float("nan")] * dim), (903, [])]
    table = spark.createDataFrame(rows, "id long, vector array<double>")
    cells.write_cells(*cells.build_cells(table, "id", n_cells), str(tmp_path / "ix"))
    asked = [(f"q{i}", x[i * 9].tolist()) for i in range(20)] + [("far", (-x[0]).tolist()), ("none", None)]
    got = [(r.q, r.rank, r.id, round(r.cosine, 6)) for r in cells.nearest(
        spark.createDataFrame(asked, "q string, vector array<double>"), *cells.read_cells(spark, str(tmp_path / "ix")), "q", "id", 5).collect()]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = []
    for name, v in asked[:-1]:
        cosine = unit @ (np.array(v) / np.linalg.norm(v))
        order = sorted(range(240), key=lambda i: (-round(cosine[i], cells.DIGITS), i))[:5]
        want += [(name, k + 1, i, round(cosine[i], 6)) for k, i in enumerate(order)]
    assert sorted(got) == sorted(want)


def test_empty_table_and_lost_members(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vector array<double>")
    members, table = cells.build_cells(none, "id")
    assert cells.nearest(spark.createDataFrame([(1, [1.0])], "q long, vector array<double>"), members, table, "q", "id").collect() == []
    some = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "id long, vector array<double>")
    members, table = cells.build_cells(some, "id", 3)
    cells.write_cells(members.where("id <> 4"), table, str(tmp_path / "ix"))
    with pytest.raises(ValueError, match="do not hold"):
        cells.read_cells(spark, str(tmp_path / "ix"))
