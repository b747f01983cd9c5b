from fleetgauge import vocab as v

SCHEMA = (
    "file_id string, row bigint, timestamp_s double, ego_speed_mps double, ego_acceleration_mps2 double, "
    "relative_distance_m double, relative_velocity_mps double, object_class string, object_confidence double, "
    "brake_command double, aeb_state double, weather string"
)


def log(file_id="file_a", n=500, dt=0.02, brake_at=4.92, drop=(), change=None, closing=True):
    """A plain log: constant closing from 3 s, braking at ``brake_at``; ``change(row, values)`` edits."""
    rows = []
    for r in range(n):
        t = r * dt
        if any(a <= t < b for a, b in drop):
            continue
        x = {
            "t": t, "speed": 13.9, "accel": 0.0, "gap": max(0.0, 30.0 - max(0.0, t - 3) * 5) if closing else 30.0,
            "rel_v": -5.0 if closing and t >= 3 else 0.0, "conf": 0.9,
            "brake": 1.0 if brake_at is not None and t >= brake_at else 0.0,
        }
        if change:
            change(r, x)
        rows.append((file_id, len(rows), x["t"], x["speed"], x["accel"], x["gap"], x["rel_v"], "vehicle", x["conf"],
                     x["brake"], 0.0, "clear"))
    return rows


def frames(spark, *logs, present=v.SIGNALS):
    rows = [r for one in logs for r in one]
    telemetry = spark.createDataFrame(rows, SCHEMA)
    ids = sorted({r[0] for r in rows})
    files = spark.createDataFrame(
        [(i, f"{i}.csv", "unknown", None, list(present), []) for i in ids],
        "file_id string, source_path string, data_origin string, scenario_id string, present array<string>, "
        "conversions array<struct<source_column:string,target_column:string,source_unit:string,target_unit:string,factor:double>>")
    return telemetry, files
