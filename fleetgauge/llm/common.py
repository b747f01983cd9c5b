"""Shared pieces: tables, text batches and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.session import stored

#: Bytes of text that one step of a vectorised function holds at a time; a longer text is a step of its own.
STEP_BYTES = 2 << 20
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batch: pa.RecordBatch, column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces of about ``size`` bytes of ``column``, so memory does not follow the batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def by_text(docs: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over the named columns, in pieces of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch):
                yield fn(piece)

    return docs.select(*columns).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges ``(a, b)``: one row ``(node, root)`` per node with an edge.

    ``root`` is the smallest node reachable. Alternates large-star and small-star steps until the
    edges no longer change; each step is an aggregation (combined before the shuffle) and an
    equi-join of written tables, which adaptive execution may split at a hot node. No neighbour
    list is collected anywhere. Null ends and loops are no edges; repeated edges count once.
    """
    edges = stored(
        edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        low = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
        large = stored(both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").selectExpr("u", "v", "m")
        edges = stored(
            small.selectExpr("IF(v = m, u, v) AS u", "m AS v")
            .unionByName(small.where("v <> m").selectExpr("u", "m AS v")).distinct(), "edges")
        state = edges.selectExpr("count(*) AS n", "sum(cast(hash(u, v) AS bigint)) AS s").first()
        if state == seen:
            break
        seen = state
    return edges.selectExpr("u AS node", "v AS root").unionByName(
        edges.selectExpr("v AS node", "v AS root").distinct())
