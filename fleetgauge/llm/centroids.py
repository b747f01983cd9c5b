"""Clusters of vectors around moving centroids, with nearest centroids by the threshold algorithm.

Components become whole numbers, floor(SCALE * x), so all sums are exact and no result depends on the order of rows.
Per dimension the centroids' values form a sorted list. From a vector's value each list is walked outward, one centroid a
step; a centroid met for the first time in any dimension gets its exact distance. The sum over the dimensions of the squared gaps at the
frontier is a lower bound for every centroid not met yet, so the walk ends when it is strictly above the best
exact distance (at equality a centroid with a smaller number could still follow).

A round is one pass over the stored whole-number vectors: every task sends one row of sums per centroid, which are added
up by key. What the driver holds is the centroids, K times DIM numbers. If no centroid moves, the rounds left would repeat it and are skipped.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out; components
beyond +-LIMIT after scaling are set to it, so that distances fit in 64 bits; a repeated ``vec_id`` gets a row per
vector, and as a start such rows come in the order of their components; a null ``vec_id`` starts after all others; with fewer
than K vectors there are so many centroids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import stored

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
LIMIT = 1 << 27
#: Vectors that a task compares at a time.
STEP = 2048
FAR = np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, column: str = "embedding", dim: int = DIM) -> DataFrame:
    """``vec_id, v``: the vectors that take part, scaled to whole numbers."""
    finite = f"size({column}) = {dim} AND forall({column}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < double('Infinity'))"
    number = f"int(greatest(least(floor(greatest(least({SCALE}D * double(x), 1e15D), -1e15D)), {LIMIT}L), -{LIMIT}L))"
    return vectors.where(finite).selectExpr("vec_id", f"transform({column}, x -> {number}) AS v")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row of ``x``; at ties the smaller number."""
    k, dim = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    across = np.arange(dim)[None, :]
    who, best = np.full(len(x), k), np.full(len(x), FAR)
    met = np.zeros((len(x), k), bool)
    high = np.zeros(x.shape, np.int64)
    for row in values:
        high += row[None, :] < x
    low, active = high - 1, np.arange(len(x))
    for _ in range(k):
        here = x[active]
        below = np.where(low >= 0, here - values[np.maximum(low, 0), across], FAR)
        above = np.where(high < k, values[np.minimum(high, k - 1), across] - here, FAR)
        left = below <= above
        gap = np.minimum(below, above)
        hit = order[np.where(left, low, high), across]
        low, high = low - left, high + ~left
        fresh = np.zeros((len(active), k), bool)
        fresh[np.arange(len(active))[:, None], hit] = True
        fresh &= ~met[active]
        met[active] |= fresh
        row, number = np.nonzero(fresh)
        distance = np.full((len(active), k), FAR)
        step = here[row] - centroids[number]
        distance[row, number] = np.einsum("ij,ij->i", step, step)
        found = distance.argmin(axis=1)
        least = distance[np.arange(len(active)), found]
        better = (least < best[active]) | ((least == best[active]) & (found < who[active]))
        who[active[better]], best[active[better]] = found[better], least[better]
        stay = np.einsum("ij,ij->i", gap, gap) <= best[active]
        active, low, high = active[stay], low[stay], high[stay]
        if not len(active):
            break
    return who, best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def _moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for step in _steps(batches):
            x = _matrix(step)
            who, _ = nearest(x, centroids)
            for c in np.unique(who):
                total[c] += x[who == c].sum(axis=0)
            count += np.bincount(who, minlength=len(centroids))
        used = np.flatnonzero(count)
        # the count goes along as one more component
        rows = np.hstack([total, count[:, None]])[used]
        yield pa.RecordBatch.from_pydict({"c": pa.array(used, pa.int32()), "sums": pa.array(rows.tolist(), pa.list_(pa.int64()))})

    added = whole.select("v").mapInArrow(sums, "c int, sums array<bigint>").selectExpr("c", "posexplode(sums) AS (d, s)")
    added = added.groupBy("c", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    totals = {(r.c, r.d): int(r.s) for r in added.collect()}  # at most K * (DIM + 1) rows
    out, dim = centroids.copy(), centroids.shape[1]
    for c in range(len(centroids)):
        if (c, dim) in totals:
            out[c] = [totals[c, d] // totals[c, dim] for d in range(dim)]
    return out


def clusters(vectors: DataFrame, column: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part."""
    spark = vectors.sparkSession
    whole = stored(whole_vectors(vectors, column, dim), "whole-vectors")
    first = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = whole.orderBy(first.asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in starts], np.int64).reshape(len(starts), dim)
    for _ in range(rounds if len(starts) else 0):
        moved = _moved(whole, centroids)
        if (moved == centroids).all():
            break
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _steps(batches):
            who, distance = nearest(_matrix(step), centroids)
            yield pa.RecordBatch.from_arrays([step.column("vec_id"), pa.array(who, pa.int32()), pa.array(distance)],
                                             ["vec_id", "cluster", "distance"])

    id_type = dict(vectors.dtypes)["vec_id"]
    assigned = stored(whole.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance bigint"), "assigned")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), digest(centroids[c])) for c, s in inertia.items()],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(  # K rows at most
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
