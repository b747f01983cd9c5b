"""JSON sinks of reports and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.operators.verification import assert_traceable


def write_report_documents(documents: DataFrame, registry: DataFrame, own_ids: DataFrame, path: str) -> None:
    """One JSON line per report, spread over directories by id; refuses untraceable reports and lists all ids."""
    texts = documents.selectExpr("file_id AS key", "document AS text")
    refused = f"{path}__unknown_ids"
    assert_traceable(texts, registry, own_ids).write.mode("overwrite").parquet(refused)
    if n := texts.sparkSession.read.parquet(refused).count():
        raise ValueError(f"report cites {n} unknown evidence IDs, listed in {refused}")
    documents.select(
        F.substring("report_id", 8, 2).alias("shard"), F.col("document").alias("value")
    ).repartition("shard").write.mode("overwrite").partitionBy("shard").text(path)


def write_evaluation(results: DataFrame, aggregates: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(f"{path}/cases")
    aggregates.write.mode("overwrite").json(f"{path}/aggregates")


def read_evaluation(spark: SparkSession, path: str, results_schema, aggregates_schema) -> tuple[DataFrame, DataFrame]:
    """A stored evaluation as baseline; schemas are given, so a null column keeps its type."""
    return (spark.read.schema(results_schema).json(f"{path}/cases"),
            spark.read.schema(aggregates_schema).json(f"{path}/aggregates"))
