"""From header names and text fields to the SI telemetry table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions.ids import stable_id
from fleetgauge.functions.sqltext import num, text, texts


def _case(subject: str, pairs: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {subject} " + " ".join(f"WHEN {text(k)} THEN {text(x)}" for k, x in pairs.items()) + f" ELSE {default} END"


def resolve_columns(headers: DataFrame) -> DataFrame:
    """``file_id, header ARRAY, declared MAP`` to one row per column.

    An exact signal name wins; else a unit suffix on a known base name; else a bare base name; else
    the column passes through (``canonical`` null). A declared unit beats the suffix. A unit that
    cannot be converted stops the job.
    """
    suffix = text(v.SUFFIX_PATTERN)
    base = f"regexp_extract(source_column, {suffix}, 1)"
    known_base = _case(base, v.SIGNAL_ALIASES)
    cols = headers.selectExpr("file_id", "declared", "posexplode(header) AS (idx, source_column)").selectExpr(
        "*", f"source_column IN ({texts(v.SIGNALS)}) AS exact", f"{known_base} AS by_suffix",
        f"{_case('source_column', v.SIGNAL_ALIASES)} AS by_name",
    ).selectExpr(
        "file_id", "idx", "source_column", "declared[source_column] AS declared_unit",
        "CASE WHEN exact THEN source_column ELSE coalesce(by_suffix, by_name) END AS canonical",
        f"CASE WHEN NOT exact AND by_suffix IS NOT NULL THEN "
        f"{_case(f'regexp_extract(source_column, {suffix}, 2)', v.SUFFIX_UNITS)} END AS suffix_unit",
    ).withColumn("target_unit", F.expr(_case("canonical", v.SIGNAL_UNITS))).withColumn(
        "unit", F.expr("IF(canonical IS NULL, NULL, coalesce(declared_unit, suffix_unit, target_unit))"))
    factors = " ".join(
        f"WHEN unit = {text(a)} AND target_unit = {text(b)} THEN {num(f)}" for (a, b), f in v.UNIT_FACTORS.items())
    problem = "concat('cannot convert ', source_column, ' from ', unit, ' to ', target_unit)"
    return cols.selectExpr(
        "file_id", "idx", "source_column", "canonical", "unit", "target_unit",
        f"CASE WHEN canonical IS NULL OR unit = target_unit THEN NULL {factors} "
        f"ELSE CAST(raise_error({problem}) AS DOUBLE) END AS factor")


NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def header_conflicts(resolved: DataFrame) -> DataFrame:
    """Signals claimed by more than one column of a file; a file with such a row is refused."""
    return resolved.filter("canonical IS NOT NULL").groupBy("file_id", "canonical").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("source_column")).alias("columns")
    ).filter("n > 1")


def file_layout(resolved: DataFrame) -> DataFrame:
    """One row per file without header conflicts: position and factor of each signal, and the passthrough columns."""
    refused = header_conflicts(resolved).select("file_id").distinct()
    resolved = resolved.join(refused, "file_id", "left_anti")
    places = []
    for s in v.SIGNALS:
        places += [F.expr(f"max(CASE WHEN canonical = '{s}' THEN idx END) AS at_{s}"),
                   F.expr(f"max(CASE WHEN canonical = '{s}' THEN factor END) AS by_{s}")]
    extras = ("array_sort(collect_list(CASE WHEN canonical IS NULL THEN named_struct('idx', idx, 'name', source_column) END)) "
              "AS extra_columns")
    return resolved.groupBy("file_id").agg(*places, F.expr(extras))


def normalise(lines: DataFrame, layout: DataFrame, keys: list[str]) -> DataFrame:
    """Text rows (``row, fields``) to signals, converted once. ``raw_<signal>`` keeps the text so
    that coerced values can be counted; ``extras`` carries unknown columns."""
    joined = lines.join(layout, keys)
    cell = "try_element_at(fields, at_{0} + 1)"
    raw = [f"CASE WHEN {cell.format(s)} NOT IN ({texts(v.NA_STRINGS)}) THEN {cell.format(s)} END AS raw_{s}"
           for s in v.SIGNALS]
    typed = []
    for s in v.SIGNALS:
        if s in v.NUMERIC_SIGNALS:
            # a cast alone would also take type suffixes and hexadecimal floats
            value = f"IF(trim(raw_{s}) RLIKE '{NUMBER}', nanvl(try_cast(trim(raw_{s}) AS DOUBLE), NULL), NULL)"
            typed.append(f"IF(by_{s} IS NULL, {value}, {value} * by_{s}) AS {s}")
        else:
            typed.append(f"raw_{s} AS {s}")
    extras = ("map_from_entries(transform(extra_columns, e -> struct(e.name, try_element_at(fields, e.idx + 1)))) AS extras")
    return joined.selectExpr("*", *raw).selectExpr(
        "file_id", "row", *typed, extras, *[f"raw_{s}" for s in v.NUMERIC_SIGNALS])


def coerced_counts(normalised: DataFrame) -> DataFrame:
    """Values per numeric signal that were there but are not numbers."""
    counts = normalised.groupBy("file_id").agg(*[
        F.expr(f"count_if(raw_{s} IS NOT NULL AND {s} IS NULL) AS {s}") for s in v.NUMERIC_SIGNALS])
    return counts.unpivot("file_id", list(v.NUMERIC_SIGNALS), "signal", "coerced").filter("coerced > 0")


def telemetry_of(normalised: DataFrame) -> DataFrame:
    return normalised.select("file_id", "row", *v.SIGNALS, "extras")


def provenance_of(resolved: DataFrame, files: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """Provenance per file without header conflicts, from its resolved columns; ``files``: file_id, source_path,
    data_origin, scenario_id (and more, kept).

    ``refused`` names the files with conflicts if the caller knows them: a log in several parts has the columns of
    all its headers, which may name a signal differently.
    """
    refused = header_conflicts(resolved) if refused is None else refused
    resolved = resolved.join(refused.select("file_id").distinct(), "file_id", "left_anti")
    names = ", ".join(f"'{s}'" for s in v.SIGNALS)
    per_file = resolved.groupBy("file_id").agg(
        F.expr(f"filter(array({names}), s -> array_contains(collect_set(canonical), s)) AS present"),
        F.expr("map_from_entries(array_sort(collect_set(CASE WHEN canonical <> source_column THEN "
               "struct(source_column, canonical) END))) AS renamed"),
        F.expr("array_sort(collect_set(CASE WHEN factor IS NOT NULL THEN named_struct('source_column', source_column, "
               "'target_column', canonical, 'source_unit', unit, 'target_unit', target_unit, 'factor', factor) END)) "
               "AS conversions"),
        F.expr("array_sort(collect_set(CASE WHEN canonical IS NULL THEN source_column END)) AS passthrough"),
    )
    return files.join(per_file, "file_id")


def file_key(path):
    return stable_id("file", path)
