"""Header resolution and unit normalisation over logs written out as text rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.operators import ingest as ing
from fleetgauge.plans import fixtures as fx
from fleetgauge.session import shared_folder
from fleetgauge.sources import documents as docs
from fleetgauge.sources import telemetry as src
from fleetgauge.plans.registry import r6, register
from fleetgauge.plans.views import VIEWS

# headers differ between logs: km/h speeds, milliseconds, an unknown column, a clash in every 12th
VIEWS["v_headers"] = """
SELECT file_id, idx, name FROM (SELECT file_id, unnest(header) AS name, generate_subscripts(header, 1) - 1 AS idx FROM (
  SELECT file_id, CASE cls % 3 WHEN 0 THEN ['timestamp_s', 'ego_speed_kmh', 'relative_distance', 'note']
    WHEN 1 THEN ['time_ms', 'ego_speed', 'relative_distance_m', 'note']
    ELSE ['timestamp', 'ego_speed_mps', 'relative_distance_m', CASE WHEN cls = 11 THEN 'ego_speed_kmh' ELSE 'note' END] END AS header FROM v_files) x) y"""
VIEWS["v_columns"] = """
SELECT file_id, idx, name AS source_column, CASE WHEN name LIKE 'time%' THEN 'timestamp_s' WHEN name LIKE 'ego%' THEN 'ego_speed_mps'
    WHEN name LIKE 'rel%' THEN 'relative_distance_m' END AS canonical,
  CASE name WHEN 'time_ms' THEN 'ms' WHEN 'ego_speed_kmh' THEN 'km/h' WHEN 'note' THEN NULL WHEN 'timestamp' THEN 's' WHEN 'timestamp_s' THEN 's'
    WHEN 'relative_distance' THEN 'm' WHEN 'relative_distance_m' THEN 'm' ELSE 'm/s' END AS unit FROM v_headers"""


def _headers(spark, sf_dir):
    return fx.provenance(spark, sf_dir).selectExpr(
        "file_id", "cast(right(file_id, 12) as bigint) % 12 as cls").selectExpr(
        "file_id", "case cls % 3 when 0 then array('timestamp_s', 'ego_speed_kmh', 'relative_distance', 'note') "
        "when 1 then array('time_ms', 'ego_speed', 'relative_distance_m', 'note') "
        "else array('timestamp', 'ego_speed_mps', 'relative_distance_m', if(cls = 11, 'ego_speed_kmh', 'note')) end as header",
        "cast(map() as map<string,string>) as declared")


def _normalised(spark, sf_dir):
    """Every log as text rows in its own header's units, one broken value per 100 rows, normalised."""
    cls = "cast(right(file_id, 12) as bigint) % 12"
    rows = fx.telemetry(spark, sf_dir).selectExpr("file_id", "row", f"{cls} as cls", v.TIMESTAMP, v.SPEED, v.GAP).selectExpr(
        "file_id", "row", f"array(cast(if(cls % 3 = 1, {v.TIMESTAMP} * 1e3, {v.TIMESTAMP}) as string), "
        f"if(row % 100 = 7, 'oops', cast(if(cls % 3 = 0, {v.SPEED} * 3.6e0, {v.SPEED}) as string)), "
        f"coalesce(cast({v.GAP} as string), 'NA'), 'x') as fields")  # conflicting logs are refused by their layout
    layout = ing.file_layout(ing.resolve_columns(_headers(spark, sf_dir)))
    return ing.normalise(rows, layout, ["file_id"])


@register("resolve_columns", "SELECT file_id, idx, source_column, canonical, unit FROM v_columns")
def resolve_columns(spark, sf_dir):
    return ing.resolve_columns(_headers(spark, sf_dir)).select("file_id", "idx", "source_column", "canonical", "unit")


@register("header_conflict_check", """
SELECT file_id, canonical, count(*) AS n FROM v_columns WHERE canonical IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def header_conflict_check(spark, sf_dir):
    return ing.header_conflicts(ing.resolve_columns(_headers(spark, sf_dir))).select("file_id", "canonical", "n")


@register("unit_normalise", """
SELECT file_id, row, round(t, 6) AS timestamp_s, CASE WHEN row % 100 <> 7 THEN round(speed, 6) END AS ego_speed_mps, round(gap, 6) AS relative_distance_m
FROM v_tel WHERE cls <> 11""")
def unit_normalise(spark, sf_dir):
    out = _normalised(spark, sf_dir)
    return out.select("file_id", "row", *[r6(c).alias(c) for c in (v.TIMESTAMP, v.SPEED, v.GAP)])


@register("coerce_numeric", """
SELECT file_id, 'ego_speed_mps' AS signal, count(*) AS coerced FROM v_tel WHERE cls <> 11 AND row % 100 = 7 GROUP BY 1""")
def coerce_numeric(spark, sf_dir):
    return ing.coerced_counts(_normalised(spark, sf_dir))


@register("file_provenance", """
SELECT file_id, string_agg(canonical, ',' ORDER BY CASE canonical WHEN 'timestamp_s' THEN 1 WHEN 'ego_speed_mps' THEN 2 ELSE 3 END) AS present,
  count(*) FILTER (WHERE unit IN ('ms', 'km/h')) AS conversions FROM (
  SELECT DISTINCT file_id, canonical, unit FROM v_columns WHERE canonical IS NOT NULL) x
WHERE file_id NOT IN (SELECT file_id FROM v_files WHERE cls = 11) GROUP BY 1""")
def file_provenance(spark, sf_dir):
    headers = _headers(spark, sf_dir)
    rows = ing.provenance_of(ing.resolve_columns(headers), headers.select("file_id"))
    return rows.select("file_id", F.array_join("present", ",").alias("present"),
                       F.size("conversions").cast("bigint").alias("conversions"))


def _exported(spark, sf_dir):
    """The fleet as CSV logs: km/h speeds, a bare time column whose unit the sidecar declares, notes with quotes and line breaks."""
    path = f"{shared_folder(spark)}/fleetgauge-csv-{uuid.uuid4().hex}"
    frame = src.to_export(fx.telemetry(spark, sf_dir).select("file_id", "row", v.TIMESTAMP, v.SPEED, v.GAP, v.REL_V))
    frame = frame.selectExpr(
        "file_id", "row", f"{v.TIMESTAMP} * 1e3 AS timestamp", "ego_speed_kmh", f"{v.GAP}", "relative_velocity_kmh",
        "CASE row % 7 WHEN 0 THEN concat('say \"', row, '\",', chr(10), chr(10), 'then go on') WHEN 1 THEN 'a, b' ELSE 'plain' END AS note")
    src.write_export(frame, path)
    sidecar = "to_json(struct(concat('SCN-', file_id) AS scenario_id, 'synthetic' AS data_origin, map('timestamp', 'ms') AS column_units))"
    sidecars = fx.telemetry(spark, sf_dir).select("file_id").distinct().selectExpr(
        "concat('file_id=', coalesce(file_id, '__HIVE_DEFAULT_PARTITION__')) AS folder", "'sidecar.json' AS name", f"array({sidecar}) AS lines")
    docs.write_files(sidecars, path)
    return path


def _log(column="source_path"):
    return F.regexp_extract(column, "file_id=([^/]+)", 1).alias("file_id")


@register("telemetry_scan", """
SELECT file_id, row, round(t, 6) AS timestamp_s, round(speed, 6) AS ego_speed_mps, round(gap, 6) AS relative_distance_m,
  CASE row % 7 WHEN 0 THEN concat('say "', row, '",', chr(10), chr(10), 'then go on') WHEN 1 THEN 'a, b' ELSE 'plain' END AS note FROM v_tel""")
def telemetry_scan(spark, sf_dir):
    path = _exported(spark, sf_dir)
    logs = src.load_telemetry(spark, f"{path}/*", src.read_sidecars(spark, path, "*.json"))
    named = logs.telemetry.join(logs.provenance.select("file_id", _log().alias("log")), "file_id")
    return named.select(F.col("log").alias("file_id"), "row", *[r6(c).alias(c) for c in (v.TIMESTAMP, v.SPEED, v.GAP)],
                        F.col("extras")["note"].alias("note"))


@register("sidecar_scan", """
SELECT file_id, concat('SCN-', file_id) AS scenario_id, 'synthetic' AS data_origin, count(*) AS rows, 3 AS conversions FROM v_tel GROUP BY 1""")
def sidecar_scan(spark, sf_dir):
    path = _exported(spark, sf_dir)
    logs = src.load_telemetry(spark, f"{path}/*", src.read_sidecars(spark, path, "*.json"))
    return logs.provenance.select(_log(), "scenario_id", "data_origin", "rows", F.size("conversions").alias("conversions"))


def _document_files(spark, sf_dir):
    path = f"{shared_folder(spark)}/fleetgauge-md-{uuid.uuid4().hex}"
    docs.write_documents(fx.raw_documents(spark, sf_dir), "doc_id", "raw", path)
    return path


def _doc_id(column):
    return F.regexp_extract(column, "doc_id=([0-9]+)", 1).cast("bigint").alias("doc_id")


@register("file_sha256", "SELECT doc_id, sha256(raw || chr(10)) AS sha256 FROM v_docs")
def file_sha256(spark, sf_dir):
    """Content hashes of the documents written as one file each."""
    return src.content_hashes(spark, _document_files(spark, sf_dir), "*.txt").select(_doc_id("source_path"), "sha256")


@register("document_scan", "SELECT doc_id, CAST(length(raw) + 1 AS BIGINT) AS chars, sha256(raw || chr(10)) AS sha256 FROM v_docs")
def document_scan(spark, sf_dir):
    return docs.read_documents(spark, f"{_document_files(spark, sf_dir)}/*", "*.txt").select(
        _doc_id("source_path"), F.length("raw").cast("bigint").alias("chars"), F.sha2("raw", 256).alias("sha256"))
