"""Markdown documents and the stored chunk index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.sources import listing


def read_documents(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """``source_path, file_name, raw``, one row per document. Tasks list and read the files; the driver holds no names."""
    return listing.whole_texts(listing.listed_files(spark, path, pattern))


FOLDERS = 256


def _written(path: str):
    """Writes ``folder, name, lines`` as files under a path that tasks reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
        made = set()
        for batch in batches:
            for folder, name, lines in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "lines"))):
                if folder not in made:
                    files.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                with files.open_output_stream(f"{root}/{folder}/{name}") as stream:
                    for line in lines:
                        stream.write(line.encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
    return run


def write_documents(documents: DataFrame, key: str, column: str, path: str) -> int:
    """One file ``key=....txt`` per key under ``path``, with its texts as lines; returns how many.

    The files lie in FOLDERS folders by hash. Each task puts its files where they stay, so nothing is moved afterwards, and a task
    that runs again writes the same names.
    """
    # a text that is missing is an empty line
    lines = documents.groupBy(key).agg(F.collect_list(F.coalesce(column, F.lit(""))).alias("lines"))
    named = lines.selectExpr(f"pmod(xxhash64({key}), {FOLDERS}) AS folder", f"concat('{key}=', coalesce(CAST({key} AS STRING), ''), '.txt') AS name", "lines")
    return write_files(named, path)


def write_files(files: DataFrame, path: str) -> int:
    """Files of ``folder, name, lines`` under ``path``; returns how many."""
    return files.select("folder", "name", "lines").mapInArrow(_written(path), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_index(indexed: DataFrame, postings: DataFrame, path: str, provider: str, model: str) -> None:
    """Chunks with vectors by source type, postings, and a one-row manifest."""
    indexed.write.mode("overwrite").partitionBy("source_type").parquet(f"{path}/chunks")
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    indexed.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimension")).select(
        F.lit(v.INDEX_FORMAT).alias("format"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), "dimension", "chunks",
    ).write.mode("overwrite").json(f"{path}/manifest")


def read_index(spark: SparkSession, path: str, provider: str) -> tuple[DataFrame, DataFrame]:
    """The stored index after checking format, provider, number of chunks and vector size."""
    manifest = spark.read.json(f"{path}/manifest").first()
    if manifest["format"] != v.INDEX_FORMAT:
        raise ValueError(f"unsupported index format {manifest['format']!r}")
    if manifest["provider"] != provider:
        raise ValueError(f"index embedded with {manifest['provider']!r}, query provider is {provider!r}")
    chunks = spark.read.parquet(f"{path}/chunks")
    seen = chunks.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"count_if(size(vector) <> {int(manifest['dimension'])})").alias("bad")).first()
    if seen["n"] != manifest["chunks"] or seen["bad"]:
        raise ValueError(f"index has {seen['n']} chunks, {seen['bad']} with a wrong vector size")
    return chunks, spark.read.parquet(f"{path}/postings")
