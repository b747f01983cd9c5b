"""Nearest vectors by cosine through coarse cells, exactly.

Unit vectors are dealt to the nearest of ``CELLS`` centres, which are vectors of the table itself. For a query q, a centre c and a
vector v of its cell, |d(q, c) - d(c, v)| <= d(q, v) by the triangle inequality. So a cell whose vectors all lie
within its radius of c holds nothing nearer than d(q, c) - radius: after the ``FIRST`` most promising cells of
a query have been searched, only cells that could still beat its k-th vector are. Inside a cell the same bound
per vector leaves out all but a range of distances to the centre.

Cells of any size are cut into blocks of about ``BLOCK`` vectors, so a cell that holds a third of the table is as many groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetgauge.operators.retrieval import l2_normalise
from fleetgauge.session import stored

CELLS = 256
FIRST = 2
BLOCK = 8192
QUERIES = 512
#: Distances are compared with this much slack, against rounding.
SLACK = 1e-9
#: Digits of a cosine that rank; equal ones go by id.
DIGITS = 9


def _unit(vectors: DataFrame, key: str) -> DataFrame:
    """``key, v``: unit vectors; null, empty, zero and non-finite vectors have no direction and are left out."""
    usable = ("size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) "
              "AND exists(vector, x -> x <> 0)")
    cast = vectors.selectExpr(key, "transform(vector, x -> double(x)) AS vector").where(usable)
    return l2_normalise(cast, "vector").withColumnRenamed("vector", "v")


def _rows(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = set(column.value_lengths().to_pylist())
    if len(sizes) > 1:
        raise ValueError(f"vector dimensions differ: {sorted(sizes)}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if x.shape[1] != centres.shape[1]:
        raise ValueError(f"vector dimensions differ: {x.shape[1]} and {centres.shape[1]}")
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ centres.T)))


def build_cells(vectors: DataFrame, key: str, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(members: key, v, cell, block, far; cells: cell, centre, radius, n, blocks) of ``key, vector``.

    Centres are the ``cells`` distinct vectors with the smallest hashes, a bounded sample; every vector is a member.
    """
    unit = stored(_unit(vectors, key), "unit-vectors")
    n = unit.count()
    # few more rows than cells are left before the distinct ones are sorted
    share = int(min(1.0, 16 * cells / max(1, n)) * (1 << 30))
    drawn = unit.where(f"pmod(xxhash64(v), {1 << 30}L) < {share}L").select("v").distinct()
    picked = [r.v for r in drawn.orderBy(F.xxhash64("v"), "v").limit(cells).collect()]  # cells rows
    if not picked and n:
        picked = [unit.orderBy(F.xxhash64("v"), "v").select("v").first().v]
    centres = np.array(picked, float).reshape(len(picked), -1 if picked else 0)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                far = _distances(_rows(batch.column("v")), centres)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "far"])

    types = dict(unit.dtypes)
    dealt = stored(unit.mapInArrow(deal, f"{key} {types[key]}, v array<double>, cell int, far double"), "cell-members")
    sizes = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).withColumn(
        "blocks", F.expr(f"ceil(n / {BLOCK})"))
    named = dealt.sparkSession.createDataFrame(list(enumerate(picked)), "cell int, centre array<double>")
    table = stored(named.join(sizes, "cell"), "cells")
    members = dealt.join(table.select("cell", "blocks"), "cell").selectExpr(key, "v", "cell", f"pmod(xxhash64({key}), blocks) AS block", "far")
    return members, table


def write_cells(members: DataFrame, cells: DataFrame, path: str) -> None:
    members.repartition("cell", "block").write.mode("overwrite").parquet(f"{path}/members")
    cells.write.mode("overwrite").parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The stored cells after checking that every member's cell is there with its number of vectors."""
    members, cells = spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/cells")
    bad = members.groupBy("cell").agg(F.count("*").alias("have")).join(cells, "cell", "full").where("NOT (have <=> n)")
    if not bad.isEmpty():
        raise ValueError("stored cells do not hold the vectors their table names")
    return members, cells


def _search(key: str, query_key: str, top_k: int, schema: pa.Schema):
    def run(asks: pa.Table, held: pa.Table) -> pa.Table:
        if not asks.num_rows or not held.num_rows:
            return schema.empty_table()
        held = held.sort_by("far")
        q, v = _rows(asks.column("_q")), _rows(held.column("v"))
        far, to_centre, limit = (t.column(c).to_numpy() for t, c in ((held, "far"), (asks, "to_centre"), (asks, "limit")))
        out = [], [], []
        # members that can be near enough are a range of distances to the centre
        low = np.searchsorted(far, to_centre - limit - SLACK)
        high = np.searchsorted(far, to_centre + limit + SLACK, side="right")
        ids = held.column(key)
        rank_of = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object), kind="stable"), kind="stable")
        for i in range(len(q)):
            a, b = int(low[i]), int(high[i])
            if a >= b:
                continue
            cosine = v[a:b] @ q[i]
            best = np.lexsort((rank_of[a:b], -np.round(cosine, DIGITS)))[:top_k]
            out[0].extend([i] * len(best)), out[1].extend((a + best).tolist()), out[2].extend(cosine[best].tolist())
        return pa.Table.from_arrays(
            [asks.column(query_key).take(pa.array(out[0], pa.int64())), ids.take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.float64())], schema=schema)
    return run


def nearest(queries: DataFrame, members: DataFrame, cells: DataFrame, query_key: str, key: str, top_k: int = 10) -> DataFrame:
    """``query_key, rank, key, cosine`` of the ``top_k`` vectors nearest to each query, equal cosines (to DIGITS digits) by key."""
    asked = stored(_unit(queries, query_key).withColumnRenamed("v", "_q"), "vector-queries")
    known = cells.orderBy("cell").collect()  # CELLS rows at most
    centres = np.array([r.centre for r in known], float).reshape(len(known), -1 if known else 0)
    radius, number = np.array([r.radius for r in known]), np.array([r.cell for r in known], np.int32)
    types, id_type = dict(asked.dtypes), dict(members.dtypes)[key]

    def bound(batches):
        for batch in batches:
            if batch.num_rows and len(number):
                d = _distances(_rows(batch.column("_q")), centres)
                row = np.repeat(np.arange(len(d)), len(number))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(np.tile(number, len(d))), pa.array(d.ravel()),
                     pa.array(np.maximum(0.0, d - radius).ravel())], [query_key, "cell", "to_centre", "least"])

    bounds = stored(asked.mapInArrow(bound, f"{query_key} {types[query_key]}, cell int, to_centre double, least double"), "cell-bounds")
    blocks = max(1, -(-asked.count() // QUERIES))
    places = Window.partitionBy(query_key).orderBy("least", "to_centre", "cell")
    first = stored(bounds.withColumn("_place", F.row_number().over(places)).where(f"_place <= {FIRST}").drop("_place"), "first-cells")
    arrow = pa.schema([(query_key, asked.limit(0).toArrow().schema.field(0).type), (key, members.limit(0).select(key).toArrow().schema.field(0).type),
                       ("cosine", pa.float64())])

    def searched(pairs: DataFrame) -> DataFrame:
        """The best of every block that a query is sent to; ``limit`` is the distance it must not exceed."""
        sent = pairs.join(asked, query_key).join(cells.select("cell", "blocks"), "cell").selectExpr(
            "*", f"pmod(xxhash64({query_key}), {blocks}) AS qb", "explode(sequence(0L, blocks - 1)) AS block")
        wanted = sent.select("cell", "block", "qb").distinct()
        held = members.join(wanted, ["cell", "block"]).select(*members.columns, "qb")
        held = held.toDF(*held.columns)
        keys = ("cell", "block", "qb")
        return sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
            _search(key, query_key, top_k, arrow), f"{query_key} {types[query_key]}, {key} {id_type}, cosine double")

    ranked = Window.partitionBy(query_key).orderBy(F.desc(F.round("cosine", DIGITS)), key)
    best = stored(searched(first.withColumn("limit", F.lit(4.0))), "first-near")
    kth = best.withColumn("_place", F.row_number().over(ranked)).where(f"_place = {top_k}").selectExpr(
        query_key, f"sqrt(greatest(0D, 2D - 2D * (round(cosine, {DIGITS}) - {10.0 ** -DIGITS}D))) AS kth")
    rest = bounds.join(first.select(query_key, "cell"), [query_key, "cell"], "left_anti").join(kth, query_key, "left").withColumn(
        "limit", F.coalesce("kth", F.lit(4.0))).where(f"least <= limit + {SLACK}").drop("kth")
    return best.unionByName(searched(rest)).withColumn("rank", F.row_number().over(ranked)).where(f"rank <= {top_k}").select(
        query_key, "rank", key, "cosine")
