import json

import pytest

from fleetgauge.operators import ingest as ing
from fleetgauge.sources import telemetry as src


def _resolve(spark, header, declared=None):
    df = spark.createDataFrame([("file_a", header, declared or {})],
                               "file_id string, header array<string>, declared map<string,string>")
    return ing.resolve_columns(df)


def test_header_resolution(spark):
    rows = {r["source_column"]: (r["canonical"], r["unit"]) for r in _resolve(
        spark, ["ego_speed_kmh", "ego_speed", "timestamp_ms", "steering_angle_deg", "time", "weather"]).collect()}
    assert rows["ego_speed_kmh"] == ("ego_speed_mps", "km/h")
    assert rows["ego_speed"] == ("ego_speed_mps", "m/s")
    assert rows["timestamp_ms"] == ("timestamp_s", "ms")
    assert rows["time"] == ("timestamp_s", "s")
    assert rows["steering_angle_deg"] == (None, None)
    declared = _resolve(spark, ["ego_speed"], {"ego_speed": "km/h"}).first()
    assert declared["unit"] == "km/h" and declared["factor"] == 1.0 / 3.6


@pytest.mark.parametrize("pair", [("ego_speed_kmh", "ego_speed_mps"), ("ego_speed", "ego_speed_kmh"),
                                  ("timestamp_s", "time_ms")])
def test_conflicts(spark, pair):
    assert ing.header_conflicts(_resolve(spark, list(pair))).count() == 1


def test_unknown_unit_stops(spark):
    with pytest.raises(Exception, match="cannot convert"):
        _resolve(spark, ["ego_speed"], {"ego_speed": "knots"}).collect()


def test_csv_files_with_different_headers(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (a / "telemetry.csv").write_text(
        'timestamp_ms,ego_speed_kmh,note\n0,36.0,"x, y"\n100,36.0,\n200,oops,NA\n300,36.0,z\n')
    (b / "telemetry.csv").write_text("ego_speed_mps,timestamp_s\n10.0,0.0\nNaN,0.1\n")
    (b / "scenario.json").write_text(json.dumps({"scenario_id": "SCN-1", "data_origin": "synthetic", "x": 1}))
    logs = src.load_telemetry(spark, f"{tmp_path}/*", src.read_sidecars(spark, str(tmp_path)))
    rows = logs.telemetry.join(logs.provenance.select("file_id", "source_path"), "file_id").orderBy(
        "source_path", "row").collect()
    assert [r["row"] for r in rows] == [0, 1, 2, 3, 0, 1]
    assert [round(r["timestamp_s"], 9) for r in rows] == [0.0, 0.1, 0.2, 0.3, 0.0, 0.1]
    assert [r["ego_speed_mps"] for r in rows] == [10.0, 10.0, None, 10.0, 10.0, None]
    assert rows[0]["extras"]["note"] == "x, y"
    coerced = logs.coerced.collect()
    assert [(r["signal"], r["coerced"]) for r in coerced] == [("ego_speed_mps", 1)]
    files = {r["source_path"].split("/")[-2]: r for r in logs.provenance.collect()}
    assert files["b"]["scenario_id"] == "SCN-1" and files["a"]["data_origin"] == "unknown"
    assert files["a"]["present"] == ["timestamp_s", "ego_speed_mps"]
    assert files["a"]["passthrough"] == ["note"]
    assert src.content_hashes(spark, str(tmp_path)).count() == 2


def test_malformed_sidecar_stops(spark, tmp_path):
    (tmp_path / "scenario.json").write_text("{not json")
    with pytest.raises(Exception):
        src.read_sidecars(spark, str(tmp_path)).collect()
