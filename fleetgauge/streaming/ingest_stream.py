"""Landing directory -> gates and metrics -> stored tables, in micro-batches.

Each micro-batch runs the batch operators on the logs that became complete and replaces their rows, so a
repeated batch leaves the same tables. Logs that can't be analysed are listed in the table ``refused``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetgauge.operators import ingest as ing
from fleetgauge.operators.gates import quality_report
from fleetgauge.operators.metrics import Analysis, log_profile
from fleetgauge.session import stored
from fleetgauge.sources import telemetry as src
from fleetgauge.sources.tables import stored_metrics, upsert_by_file

TELEMETRY_SCHEMA = (
    "file_id STRING, row BIGINT, timestamp_s DOUBLE, ego_speed_mps DOUBLE, ego_acceleration_mps2 DOUBLE, "
    "relative_distance_m DOUBLE, relative_velocity_mps DOUBLE, object_class STRING, object_confidence DOUBLE, "
    "brake_command DOUBLE, aeb_state DOUBLE, weather STRING"
)
BINARY_FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
CLOSED = "log STRING, paths ARRAY<STRING>, expected INT"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REFUSED = "file_id STRING, log STRING, reason STRING"


def _store(spark: SparkSession, telemetry: DataFrame, files: DataFrame, tables: str, buckets: int) -> None:
    profile = stored(log_profile(telemetry, files), "profile")
    analysis = Analysis(telemetry, files, profile)
    done = profile.select("file_id")
    upsert_by_file(quality_report(profile), f"{tables}/quality", done, buckets)
    upsert_by_file(analysis.events, f"{tables}/events", done, buckets)
    upsert_by_file(stored_metrics(analysis.metrics), f"{tables}/metrics", done, buckets)


def ingest_stream(
    spark: SparkSession, landing: str, provenance: DataFrame, tables: str, checkpoint: str, buckets: int = 256
) -> StreamingQuery:
    """Starts the query over whole Parquet logs landing in ``landing``; runs what is there, then stops.

    A log is complete when its file lands. One that ``provenance`` does not know goes to ``refused``.
    """
    def run(batch: DataFrame, _: int) -> None:
        logs = stored(batch, "landed")
        landed = logs.select("file_id").distinct()
        files = provenance.join(landed, "file_id", "left_semi")
        unknown = landed.join(provenance, "file_id", "left_anti").selectExpr(
            "file_id", "CAST(NULL AS STRING) AS log", "'no provenance' AS reason")
        _store(spark, logs.join(files.select("file_id"), "file_id", "left_semi"), files, tables, buckets)
        upsert_by_file(unknown, f"{tables}/refused", landed, buckets)

    landed = spark.readStream.schema(TELEMETRY_SCHEMA).parquet(landing)
    return landed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


class LogParts(StatefulProcessor):
    """Gathers the parts of a log and gives the log when it has all of them, or when none came for ``quiet_ms``.

    State per log: the number of parts it should have (value) and the parts seen (list). Only paths are kept, so the
    state of a log is as small as its list of files, however long the log. A part that lands again takes the place of
    the earlier one. After a log is given its state is gone; a part that lands later begins it anew.
    """

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expected = handle.getValueState("expected", "n INT")
        self.parts = handle.getListState("parts", "part INT, path STRING")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen = {part: path for part, path in self.parts.get()}
        known = self.expected.get()
        expected = known[0] if known is not None else 0
        for row in rows:
            seen[row.part] = row.path
            expected = max(expected, row.parts)
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if len(seen) >= expected:
            yield self._given(key, seen, expected)
            return
        self.expected.update((expected,))
        self.parts.put(sorted(seen.items()))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.parts.exists():
            yield self._given(key, dict(self.parts.get()), self.expected.get()[0])

    def _given(self, key: Any, seen: dict[int, str], expected: int) -> Row:
        self.parts.clear()
        self.expected.clear()
        return Row(log=key[0], paths=[seen[p] for p in sorted(seen)], expected=expected)

    def close(self) -> None:
        pass


def ingest_csv_stream(
    spark: SparkSession, landing: str, tables: str, checkpoint: str, sidecars: DataFrame | None = None, quiet_s: float = 3600.0,
    files_per_batch: int = 4096, buckets: int = 256, trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Starts the query over CSV logs landing in ``landing``, whole (``x.csv``) or in parts (``x.part2of5.csv``).

    The stream carries names of files only; what is in them is read by the batch scan when a log has all its parts,
    in whatever batches they landed. So a log that lands in parts gives the same rows as one that lands whole.
    ``quiet_s`` after its last part an incomplete log is listed in ``refused``, like one whose headers claim a signal
    twice. By default one batch takes what is there, then the query stops. As a service, ``trigger`` (what
    ``DataStreamWriter.trigger`` takes) starts batches of at most ``files_per_batch`` files. The driver holds the names of a
    batch's files, as it does for any listing. Timers run by the clock, so ``availableNow`` would not end.
    """
    spark.conf.set(STORE, ROCKS)

    def run(batch: DataFrame, _: int) -> None:
        given = batch.collect()  # names of a batch's files, and of logs whose time is over
        if not given:
            return
        ready = [p for r in given if len(r.paths) == r.expected for p in r.paths]
        keys = spark.createDataFrame([(r.log, len(r.paths), r.expected) for r in given], "log STRING, seen INT, expected INT").withColumn(
            "file_id", ing.file_key(F.col("log")))
        refused = keys.where("seen < expected").selectExpr(
            "file_id", "log", "concat('parts missing: ', seen, ' of ', expected) AS reason")
        if ready:
            logs = src.load_telemetry(spark, ready, sidecars)
            _store(spark, stored(logs.telemetry, "landed"), stored(logs.provenance, "landed-files"), tables, buckets)
            twice = logs.conflicts.groupBy("file_id").agg(F.concat(
                F.lit("claimed twice: "), F.array_join(F.array_sort(F.collect_set("canonical")), ", ")).alias("reason"))
            refused = refused.unionByName(twice.join(keys.select("file_id", "log"), "file_id").select("file_id", "log", "reason"))
        upsert_by_file(refused, f"{tables}/refused", keys.select("file_id"), buckets)

    path = F.col("_metadata.file_path")
    landed = (
        spark.readStream.format("binaryFile").schema(BINARY_FILES).option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(landing)
        .select(src.log_path(path).alias("log"), src.part_number(path).alias("part"), src.part_count(path).alias("parts"), path.alias("path"))
    )
    closed = landed.groupBy("log").transformWithState(LogParts(int(quiet_s * 1000)), CLOSED, "Append", "ProcessingTime")
    return closed.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"once": True})).start()
