"""CSV logs: scan in logged order, sidecars, content hashes, export."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.operators import ingest as ing
from fleetgauge.session import stored
from fleetgauge.sources import listing

SIDECAR_SCHEMA = "scenario_id STRING, data_origin STRING, column_units MAP<STRING,STRING>"
SIDECAR_NAME = "scenario.json"
HASH_BUFFER = 1 << 20
#: ``name.part2of5.csv`` is the second of five files of the log ``name.csv``.
PART = r"\.part([0-9]+)of([0-9]+)(?=\.csv$)"


@dataclass
class IngestedLogs:
    telemetry: DataFrame
    provenance: DataFrame
    coerced: DataFrame
    conflicts: DataFrame


def _fields(line: str) -> str:
    cut = f"regexp_extract_all(concat({line}, ','), '(\"[^\"]*+(?:\"\"[^\"]*+)*+\"|[^,]*+),', 1)"
    return (f"transform({cut}, c -> IF(startswith(c, '\"') AND endswith(c, '\"') AND length(c) > 1, "
            "replace(substring(c, 2, length(c) - 2), '\"\"', '\"'), c))")


MARKED = ("source_path string, split bigint, place bigint, value string, quotes bigint, quotes_before bigint, "
          "starts_even bigint, starts_odd bigint, blank boolean")


def _running(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums up to each value, itself included, that begin anew where ``first`` is set."""
    sums = np.cumsum(values)
    at = np.flatnonzero(first)
    return sums - np.repeat(sums[at] - values[at], np.diff(np.append(at, len(values))))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per line of a split: its place, the quotes before it, and how many records have begun if the split began outside or inside quotes.

    A task sees the lines of a split one after another, so running sums need no shuffle and no sort.
    """
    held, sums = None, np.zeros(4, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        path, split, value = (batch.column(c) for c in ("source_path", "split", "value"))
        names = path.dictionary_encode().indices.to_numpy()
        at = split.to_numpy()
        first = np.ones(len(at), bool)
        first[1:] = (names[1:] != names[:-1]) | (at[1:] != at[:-1])
        quotes = pc.count_substring(value, '"').to_numpy().astype(np.int64)
        blank = pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(value)), 0).to_numpy(zero_copy_only=False)
        goes_on = held == (path[0].as_py(), int(at[0]))
        before = _running(quotes, first) - quotes
        until = len(at) if first.sum() == 1 else int(np.flatnonzero(first)[1])
        if goes_on:
            before[:until] += sums[1]
        starts = [_running(((before % 2 == odd) & ~blank).astype(np.int64), first) for odd in (0, 1)]
        place = _running(np.ones(len(at), np.int64), first)
        if goes_on:
            place[:until] += sums[0]
            for run, carried in zip(starts, sums[2:]):
                run[:until] += carried
        held = (path[len(at) - 1].as_py(), int(at[-1]))
        sums = np.array([place[-1], before[-1] + quotes[-1], starts[0][-1], starts[1][-1]], np.int64)
        yield pa.RecordBatch.from_arrays(
            [path, split, *map(pa.array, (place,)), value, *map(pa.array, (quotes, before, *starts, blank))],
            [c.split()[0] for c in MARKED.split(", ")])


def log_path(path: Column) -> Column:
    """The path of the log a file belongs to."""
    return F.regexp_replace(path, PART, "")


def part_number(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, PART, 1), F.lit("")).cast("int"), F.lit(1))


def part_count(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, PART, 2), F.lit("")).cast("int"), F.lit(1))


def split_bytes(spark: SparkSession) -> int:
    """Bytes of a split: ``spark.sql.files.maxPartitionBytes``."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


@dataclass
class Scan:
    """``records``: source_path, split, row, fields; ``headers``: source_path, header; ``splits``: source_path, split, rows of every split."""

    records: DataFrame
    headers: DataFrame
    splits: DataFrame


def scan_records(spark: SparkSession, path: str | list[str]) -> Scan:
    """The records of every CSV under ``path`` in logged order.

    Tasks list the files and read them as text, so the driver holds no names, files with different headers share one scan, and a
    large file is cut into splits that many tasks read. A quoted field may hold line breaks, also over the edge of a split: a line
    begins a record where the number of quotes before it in the file is even. Two passes: the
    first leaves a row per split (quotes, records if it begins outside or inside quotes), whose running sums
    tell how each split begins; the second reads the lines again and needs those sums only. Lines that go on
    with a record, few as a rule, are added to the line that begins it. Nothing is sorted as a whole.

    Blank lines outside quotes are no records; a quoted line break is read as a newline; quotes that never
    close stop the job, as does a record with more fields than the header.
    """
    files = listing.listed_files(spark, path, "*.csv")
    marked = listing.lines_of(files, split_bytes(spark), _marked, MARKED)
    counted = marked.groupBy("source_path", "split").agg(
        F.sum("quotes").alias("quotes"), F.max("starts_even").alias("even"), F.max("starts_odd").alias("odd"))
    order = Window.partitionBy("source_path").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = counted.withColumns({
        "open": F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1,
        "closed": F.sum("quotes").over(Window.partitionBy("source_path")) % 2 == 0,
    }).selectExpr("source_path", "split", "open", "IF(closed, IF(open, odd, even), "
                  "CAST(raise_error(concat('quotes never close in ', source_path)) AS BIGINT)) AS began")
    splits = stored(opened.withColumns({
        "shift": F.coalesce(F.sum("began").over(before), F.lit(0)),
        # where a record goes on that began in an earlier split
        "from_split": F.last(F.when(F.col("began") > 0, F.col("split")), ignorenulls=True).over(before),
        "from_began": F.last(F.when(F.col("began") > 0, F.col("began")), ignorenulls=True).over(before),
    }), "csv-splits")
    placed = marked.join(splits, ["source_path", "split"]).selectExpr(
        "*", "IF(open, starts_odd, starts_even) AS number", "(quotes_before + int(open)) % 2 = 1 AS inside")
    begun = placed.where("NOT inside AND NOT blank").select("source_path", "split", "number", "shift", "value")
    tails = placed.where("inside").selectExpr(
        "source_path", "IF(number > 0, split, from_split) AS split", "IF(number > 0, number, from_began) AS number",
        "struct(split AS s, place, value) AS part").groupBy("source_path", "split", "number").agg(
        F.expr("array_join(transform(array_sort(collect_list(part)), p -> p.value), '\n') AS tail"))
    numbered = begun.join(tails, ["source_path", "split", "number"], "left").selectExpr(
        "source_path", "split", "shift + number - 2 AS row", "IF(tail IS NULL, value, concat(value, '\n', tail)) AS record")
    headers = stored(numbered.where("row = -1").selectExpr("source_path", f"{_fields('record')} AS header"), "csv-headers")
    width = headers.select("source_path", F.size("header").alias("width"))
    keyed = splits.join(width, "source_path").select("source_path", "split", "width")
    records = numbered.where("row >= 0").join(keyed, ["source_path", "split"]).selectExpr(
        "source_path", "split", "row", f"{_fields('record')} AS fields", "width").selectExpr(
        "source_path", "split", "row",
        "IF(size(fields) > width, raise_error(concat('too many fields in ', source_path)), fields) AS fields")
    return Scan(records, headers, splits.selectExpr("source_path", "split", "began AS rows"))


def read_sidecars(spark: SparkSession, path: str, name: str = SIDECAR_NAME) -> DataFrame:
    """``folder, scenario_id, data_origin, column_units``; a malformed sidecar stops the job."""
    read = listing.whole_texts(listing.listed_files(spark, path, name, recursive=True))
    found = f"from_json(raw, 'ARRAY<STRUCT<{SIDECAR_SCHEMA}>>', map('mode', 'FAILFAST'))"
    return read.select(F.expr(f"inline({found})"), _folder(F.col("source_path")).alias("folder"))


def _folder(path):
    return F.regexp_replace(path, "/[^/]*$", "")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for uri in batch.column("path").to_pylist():
            files, name = listing.opened(uri)
            digest = hashlib.sha256()
            with files.open_input_stream(name) as stream:
                while part := stream.read(HASH_BUFFER):
                    digest.update(part)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(digests, pa.string())], ["source_path", "sha256"])


def content_hashes(spark: SparkSession, path: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """``source_path, sha256`` of every file under ``path`` whose name fits ``pattern``.

    Tasks list the files; a task reads its files through buffers of ``HASH_BUFFER`` bytes, so a log of any
    size takes that much memory. A hash has no parts to be shared out, so one log is the work of one task.
    Empty files are not listed.
    """
    listed = listing.listed_files(spark, path, pattern, recursive=True)
    return listing.dealt(listed).select("path").mapInArrow(_hashed, "source_path string, sha256 string")


def load_telemetry(
    spark: SparkSession, path: str, sidecars: DataFrame | None = None, column_units: dict[str, str] | None = None
) -> IngestedLogs:
    """All logs under ``path`` as one SI table. Units: caller over sidecar over header suffix."""
    scan = scan_records(spark, path)
    files = scan.headers.withColumn("folder", _folder(F.col("source_path")))
    empty = F.expr("CAST(map() AS MAP<STRING,STRING>)")
    if sidecars is not None:
        files = files.join(sidecars, "folder", "left")
    else:
        files = files.withColumns({
            "scenario_id": F.lit(None).cast("string"), "data_origin": F.lit(None).cast("string"),
            "column_units": empty})
    caller = F.create_map(*[F.lit(x) for kv in (column_units or {}).items() for x in kv]).cast(
        "map<string,string>") if column_units else empty
    declared = F.map_concat(
        F.map_filter(F.coalesce("column_units", empty), lambda k, _: ~F.array_contains(F.map_keys(caller), k)), caller)
    # a log may lie in several files, one after another; each is read by its own header
    files = files.withColumns({"file_id": ing.file_key(log_path(F.col("source_path"))), "part": part_number(F.col("source_path"))})
    order = Window.partitionBy("file_id").orderBy("part", "source_path").rowsBetween(Window.unboundedPreceding, -1)
    sizes = scan.splits.groupBy("source_path").agg((F.sum("rows") - 1).alias("rows"))
    files = files.join(sizes, "source_path").withColumn("before", F.coalesce(F.sum("rows").over(order), F.lit(0)))
    resolved = ing.resolve_columns(files.select(F.col("source_path").alias("file_id"), "header", declared.alias("declared")))
    layout = ing.file_layout(resolved).withColumnRenamed("file_id", "source_path").join(
        files.select("source_path", "file_id", "before"), "source_path")
    refused = ing.header_conflicts(resolved).withColumnRenamed("file_id", "source_path").join(
        files.select("source_path", "file_id"), "source_path")
    layout = layout.join(refused.select("file_id").distinct(), "file_id", "left_anti")
    keyed = scan.splits.select("source_path", "split").join(layout, "source_path")
    shifted = scan.records.join(keyed.select("source_path", "split", "before"), ["source_path", "split"]).selectExpr(
        "source_path", "split", "row + before AS row", "fields")
    normalised = ing.normalise(shifted, keyed.drop("before"), ["source_path", "split"])
    described = files.groupBy("file_id").agg(
        F.min(log_path(F.col("source_path"))).alias("source_path"), F.min("scenario_id").alias("scenario_id"),
        F.coalesce(F.min("data_origin"), F.lit("unknown")).alias("data_origin"), F.sum("rows").alias("rows"),
        F.count("*").cast("int").alias("parts"))
    by_log = resolved.withColumnRenamed("file_id", "source_path").join(files.select("source_path", "file_id"), "source_path").drop("source_path")
    return IngestedLogs(
        ing.telemetry_of(normalised), ing.provenance_of(by_log, described, refused), ing.coerced_counts(normalised),
        refused.groupBy("file_id", "canonical").agg(F.max("n").alias("n"), F.max("columns").alias("columns")))


def to_export(telemetry: DataFrame) -> DataFrame:
    """Speeds in km/h under their export names."""
    return (
        telemetry.withColumn("ego_speed_kmh", F.col(v.SPEED) * v.MPS_TO_KMH)
        .withColumn("relative_velocity_kmh", F.col(v.REL_V) * v.MPS_TO_KMH)
        .drop(v.SPEED, v.REL_V)
    )


def write_export(telemetry: DataFrame, path: str) -> None:
    """One CSV per log, in logged order, in the folder ``file_id=...``; quotes inside fields are doubled.

    A log is one file, so its rows are written by one task, sorted on disk if they don't fit in memory. A task moves its own files
    to their place when it ends; otherwise the driver would move those of all logs one after another.
    """
    telemetry.repartition("file_id").sortWithinPartitions("file_id", "row").drop("row").write.partitionBy("file_id").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").option("escape", '"').csv(path, header=True)


def export_units(columns: list[str]) -> dict[str, str]:
    units = {**v.SIGNAL_UNITS, "ego_speed_kmh": "km/h", "relative_velocity_kmh": "km/h"}
    return {c: units[c] for c in columns if c in units}
