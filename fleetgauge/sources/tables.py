"""Stored results as Parquet tables, partitioned so that re-runs replace instead of duplicate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.ids import stable_id
from fleetgauge.operators.metrics import available, numeric_value
from fleetgauge.session import stored

FILE_BUCKETS = 256


#: Tasks that write one bucket, so a table of few buckets is still written by many.
WRITERS = 8


def file_bucket(buckets: int = FILE_BUCKETS, key: str = "file_id"):
    """Partition column of keyed tables: one directory per log would mean millions."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored_metrics(metrics: DataFrame) -> DataFrame:
    """Rows as stored: only metrics with a value, flags as 1.0 / 0.0."""
    return available(metrics).select(
        "file_id", "metric_id", "name", numeric_value().alias("value"), "unit", "passed", "t_s", "window_id")


def upsert_by_file(new: DataFrame, path: str, analysed: DataFrame, buckets: int = FILE_BUCKETS) -> None:
    """Replace the stored rows of the logs in ``analysed`` by the rows in ``new``."""
    upsert(new, path, analysed, "file_id", buckets)


def upsert(new: DataFrame, path: str, touched: DataFrame, key: str, buckets: int = FILE_BUCKETS) -> None:
    """Replace the stored rows whose ``key`` is in ``touched`` by the rows in ``new``.

    Only the buckets of those keys are rewritten. Running it twice leaves the same table. The
    merged rows are written beside the table first, since a table cannot be read and overwritten
    in one job.
    """
    spark = new.sparkSession

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition("bucket", F.pmod(F.hash(key), F.lit(WRITERS)))

    keyed = new.withColumn("bucket", file_bucket(buckets, key))
    if not _exists(spark, path):
        spread(keyed).write.partitionBy("bucket").parquet(path)
        return
    touched = touched.select(key).distinct().withColumn("bucket", file_bucket(buckets, key))
    kept = (
        spark.read.schema(keyed.schema).parquet(path)
        .join(touched.select("bucket").distinct(), "bucket", "left_semi")
        .join(touched.select(key), key, "left_anti")
    )
    staged = f"{path}__staged"
    spread(kept.unionByName(keyed)).write.mode("overwrite").partitionBy("bucket").parquet(staged)
    (
        spread(spark.read.schema(keyed.schema).parquet(staged))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket").parquet(path)
    )
    # a bucket without rows is not part of the overwrite
    filled = spark.read.schema(keyed.schema).parquet(staged).select("bucket").distinct()
    for row in touched.select("bucket").distinct().join(filled, "bucket", "left_anti").collect():  # at most ``buckets`` rows
        _delete(spark, f"{path}/bucket={row['bucket']}")


def _delete(spark, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _exists(spark, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def append_runs(runs: DataFrame, path: str, buckets: int = FILE_BUCKETS) -> None:
    """Store runs; a run that is stored again, as in a repeated job, takes the place of the first."""
    upsert(runs, path, runs, "run_id", buckets)


def approval_tasks(reports: DataFrame) -> DataFrame:
    """One open approval per report."""
    return reports.select(
        F.concat(F.lit("appr_"), F.substring(stable_id("run", F.col("report_id")), 5, 12)).alias("approval_id"),
        "project_id", "report_id", F.lit("pending_review").alias("status"),
        "human_review_required", "review_reasons")


def append_reports(reports: DataFrame, path: str, approvals_path: str, buckets: int = FILE_BUCKETS) -> None:
    """Store reports and open one approval task for each that has none; a decided task stays as it is."""
    upsert(reports, path, reports, "report_id", buckets)
    tasks = approval_tasks(reports)
    if _exists(reports.sparkSession, approvals_path):
        held = reports.sparkSession.read.parquet(approvals_path).select("approval_id")
        tasks = tasks.join(held, "approval_id", "left_anti")
    opened = stored(tasks, "approval-tasks")
    upsert(opened, approvals_path, opened, "approval_id", buckets)


def stamp(df: DataFrame, column: str, moment: dt.datetime) -> DataFrame:
    """A creation time given by the caller, so that re-runs write the same rows."""
    return df.withColumn(column, F.lit(moment))
