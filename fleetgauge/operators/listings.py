"""Views for people: listings, plots, single chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions.text import access_rank
from fleetgauge.operators import segments as sg


def list_filtered(df: DataFrame, order: list[Column], **equal: str | None) -> DataFrame:
    """Rows matching every given column value, in listing order."""
    out = df
    for name, value in equal.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out.orderBy(*order)


def downsample(telemetry: DataFrame, max_points: int) -> DataFrame:
    """Every ``ceil(n / max_points)``-th sample of a log, from the first; numeric signals only.

    The step joins per segment, so a very long log is not gathered on its key.
    """
    seg = sg.segment_of(F.col("row"))
    sizes = telemetry.select("file_id", seg.alias("seg")).groupBy("file_id", "seg").agg(
        F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("file_id"))
    steps = sizes.select(
        "file_id", "seg",
        F.greatest(F.ceil(total / F.lit(max(1, max_points))), F.lit(1)).cast("bigint").alias("step"))
    return (
        telemetry.select("file_id", "row", *v.NUMERIC_SIGNALS)
        .withColumn("seg", seg)
        .join(steps, ["file_id", "seg"])
        .filter(F.col("row") % F.col("step") == 0)
        .drop("seg")
    )


def chunk_lookup(chunks: DataFrame, wanted: DataFrame, level: str) -> DataFrame:
    """Cited chunks with a status: 200, 403 above the caller's access, 404 unknown.

    Text is only returned where access allows it.
    """
    limit = v.ACCESS_LEVELS.index(level) + 1
    status = (
        F.when(F.col("access_level").isNull(), 404)
        .when(access_rank(F.col("access_level")) > limit, 403)
        .otherwise(200)
    )
    kept = chunks.select("chunk_id", "document_title", "heading", "text", "source_type", "access_level")
    found = wanted.join(kept, "chunk_id", "left").withColumn("status", status)
    shown = ["document_title", "heading", "text", "source_type"]
    return found.select(
        "chunk_id", "status", *[F.when(F.col("status") == 200, F.col(c)).alias(c) for c in shown])
