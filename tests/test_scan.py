"""CSV records over split edges, logs in parts, content hashes."""

import csv
import hashlib
import io
import random

import pytest

from fleetgauge.sources import telemetry as src


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "23")
    spark.conf.set(names[1], "1")
    spark.conf.set(names[2], "64")
    yield
    for n, x in before.items():
        spark.conf.unset(n) if x is None else spark.conf.set(n, x)


def _text(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def _records(spark, path):
    scan = src.scan_records(spark, str(path))
    out = {}
    for r in sorted(scan.records.collect(), key=lambda r: (r.source_path, r.row)):
        out.setdefault(r.source_path.rsplit("/", 1)[1], []).append((r.row, r.fields))
    return out, {r.source_path.rsplit("/", 1)[1]: r.header for r in scan.headers.collect()}


def test_records_equal_the_csv_library_over_small_splits(spark, small_splits, tmp_path):
    rng = random.Random(1)
    pieces = ["a", "1.5", "", "x, y", 'say "hi"', "line\nbreak", "\n\n\n", '"', "two\n\nlines, and more", "é" * 30, "long " * 12]
    want = {}
    for name in ("a.csv", "b.csv", "c.csv"):
        rows = [["t", "na\nme", "c"]] + [[rng.choice(pieces) for _ in range(3)] for _ in range(25)]
        rows = [r for r in rows if any(r)]
        (tmp_path / name).write_text(_text(rows, "\r\n" if name == "b.csv" else "\n") + ("\n  \n" if name == "a.csv" else ""))
        want[name] = rows
    records, headers = _records(spark, tmp_path)
    for name, rows in want.items():
        assert headers[name] == rows[0]
        assert records[name] == [(i, r) for i, r in enumerate(rows[1:])]


def test_a_field_longer_than_many_splits(spark, small_splits, tmp_path):
    rows = [["t", "note"], ["1", "line\n" * 40 + 'and "quotes"\n' * 10], ["2", "x"]]
    (tmp_path / "a.csv").write_text(_text(rows))
    assert _records(spark, tmp_path)[0]["a.csv"] == [(0, rows[1]), (1, rows[2])]


def test_running_sums_go_on_over_batches(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [["t", "note"]] + [[str(i), "a\nb" if i % 3 else "c"] for i in range(50)]
        (tmp_path / "a.csv").write_text(_text(rows))
        assert _records(spark, tmp_path)[0]["a.csv"] == list(enumerate(rows[1:]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_open_quotes_and_long_records_stop(spark, tmp_path):
    (tmp_path / "a.csv").write_text('t,note\n1,"open\n2,x\n')
    with pytest.raises(Exception, match="quotes never close"):
        _records(spark, tmp_path)
    (tmp_path / "a.csv").write_text("t,note\n1,x,y\n")
    with pytest.raises(Exception, match="too many fields"):
        _records(spark, tmp_path)


def test_parts_of_a_log_follow_each_other(spark, tmp_path):
    (tmp_path / "x.part2of3.csv").write_text("ego_speed_kmh,timestamp_ms\n36,200\n72,300\n")
    (tmp_path / "x.part1of3.csv").write_text("timestamp_s,ego_speed_mps\n0.0,5\n0.1,6\n")
    (tmp_path / "x.part3of3.csv").write_text("time,ego_speed,note\n0.4,1,end\n")
    (tmp_path / "y.csv").write_text("time,ego_speed\n0,1\n")
    logs = src.load_telemetry(spark, str(tmp_path))
    files = {r.source_path.rsplit("/", 1)[1]: r for r in logs.provenance.collect()}
    assert {n: (r.rows, r.parts) for n, r in files.items()} == {"x.csv": (5, 3), "y.csv": (1, 1)}
    rows = logs.telemetry.where(logs.telemetry.file_id == files["x.csv"].file_id).orderBy("row").collect()
    assert [(r.row, round(r.timestamp_s, 6), round(r.ego_speed_mps, 6)) for r in rows] == [
        (0, 0.0, 5.0), (1, 0.1, 6.0), (2, 0.2, 10.0), (3, 0.3, 20.0), (4, 0.4, 1.0)]


def test_hash_through_small_buffers(spark, tmp_path):
    content = random.Random(2).randbytes(3 * src.HASH_BUFFER + 17)
    (tmp_path / "big.csv").write_bytes(content)
    (tmp_path / "none.csv").write_bytes(b"")
    got = {r.source_path.rsplit("/", 1)[1]: r.sha256 for r in src.content_hashes(spark, str(tmp_path)).collect()}
    assert got == {"big.csv": hashlib.sha256(content).hexdigest()}


def test_export_reads_back(spark, tmp_path):
    rows = [("f1", i, i / 10, 3.5 * i, None if i == 2 else 9.0, -1.0, 'a "b",\nc' if i % 2 else "x") for i in range(6)] + [("f2", 0, 0.0, 1.0, 1.0, 0.0, "")]
    tel = spark.createDataFrame(rows, "file_id string, row bigint, timestamp_s double, ego_speed_mps double, relative_distance_m double, "
                                      "relative_velocity_mps double, note string")
    src.write_export(src.to_export(tel), f"{tmp_path}/out")
    logs = src.load_telemetry(spark, f"{tmp_path}/out/*")
    log = {r.file_id: r.source_path.split("file_id=")[1].split("/")[0] for r in logs.provenance.collect()}
    got = sorted((log[r.file_id], r.row, round(r.timestamp_s, 6), round(r.ego_speed_mps, 6), r.relative_distance_m, round(r.relative_velocity_mps, 6),
                  r.extras["note"] or "") for r in logs.telemetry.collect())
    assert got == sorted((*r[:6], r[6]) for r in rows)
    assert src.export_units(src.to_export(tel).columns) == {
        "timestamp_s": "s", "ego_speed_kmh": "km/h", "relative_distance_m": "m", "relative_velocity_kmh": "km/h"}
