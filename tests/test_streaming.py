import csv

from helpers import frames, log
from pyspark.sql import functions as F

from fleetgauge.streaming.ingest_stream import ingest_csv_stream, ingest_stream


def test_landed_logs_are_stored_once(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "tables")
    tel, files = frames(spark, log("file_a"), log("file_b", drop=[(3.0, 7.0)]))
    tel.filter("file_id = 'file_a'").coalesce(1).write.mode("append").parquet(landing)
    ingest_stream(spark, landing, files, out, str(tmp_path / "ckpt"), 2).awaitTermination()
    stranger = tel.filter("file_id = 'file_b'").unionByName(tel.filter("file_id = 'file_a'").withColumn("file_id", F.lit("file_x")))
    stranger.coalesce(1).write.mode("append").parquet(landing)
    ingest_stream(spark, landing, files, out, str(tmp_path / "ckpt"), 2).awaitTermination()
    verdicts = {r["file_id"]: r["verdict"] for r in spark.read.parquet(f"{out}/quality").collect()}
    assert verdicts == {"file_a": "pass", "file_b": "blocked"}
    assert {r["file_id"] for r in spark.read.parquet(f"{out}/metrics").select("file_id").distinct().collect()} == {"file_a"}
    assert [(r.file_id, r.reason) for r in spark.read.parquet(f"{out}/refused").collect()] == [("file_x", "no provenance")]


NAMES = "timestamp_s ego_speed_mps ego_acceleration_mps2 relative_distance_m relative_velocity_mps object_class object_confidence brake_command aeb_state weather".split()


def _write(folder, name, rows, header=NAMES):
    folder.mkdir(exist_ok=True)
    with open(folder / name, "w", newline="") as f:
        csv.writer(f).writerows([header, *(r[2:] for r in rows)])


def _rows(spark, path):
    table = spark.read.parquet(f"{path}/metrics").drop("bucket", "file_id", "metric_id", "window_id")
    return sorted(tuple(r) for r in table.collect())


def test_logs_that_cannot_be_read_are_refused(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "tables")
    a = log("a", n=30)

    def run():
        ingest_csv_stream(spark, str(landing), out, str(tmp_path / "ckpt"), quiet_s=0.001, buckets=2).awaitTermination()
        return {r.log.rsplit("/", 1)[1]: r.reason for r in spark.read.parquet(f"{out}/refused").collect()}

    _write(landing, "c.part1of3.csv", a[:10])
    _write(landing, "d.csv", a, [*NAMES[:1], "ego_speed", "ego_speed_kmh", *NAMES[3:]])
    assert run() == {"d.csv": "claimed twice: ego_speed_mps"}
    _write(landing, "e.part1of2.csv", a)
    assert run() == {"d.csv": "claimed twice: ego_speed_mps", "c.csv": "parts missing: 1 of 3"}


def test_parts_wait_for_each_other(spark, tmp_path):
    landing, whole = tmp_path / "landing", tmp_path / "whole"
    a = log("a")

    def run(folder, out):
        ingest_csv_stream(spark, str(folder), str(tmp_path / out), str(tmp_path / f"ckpt-{out}"), buckets=2).awaitTermination()

    _write(whole, "a.csv", a)
    run(whole, "batch")
    _write(landing, "a.part2of3.csv", a[200:300])
    run(landing, "stream")
    assert not (tmp_path / "stream").exists()
    _write(landing, "a.part3of3.csv", a[300:], NAMES)
    run(landing, "stream")
    _write(landing, "a.part1of3.csv", a[:200])
    run(landing, "stream")
    got = _rows(spark, tmp_path / "stream")
    assert got == _rows(spark, tmp_path / "batch") and len(got) > 8
