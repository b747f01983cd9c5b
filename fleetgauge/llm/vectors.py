"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length one, so cosine >= c means squared distance <= 2 - 2c. A fixed random
rotation spreads the distance evenly over the coordinates, which are cut into ``BLOCKS`` blocks of few
dimensions. The squared distance of a pair is the sum over the blocks, so at least one block has no more than its
share of the budget (in proportion to its dimensions). Each block is range-joined for itself: its first
coordinate is cut into slabs as wide as the block's radius, a vector meets those of its own and of the next
slab, and within a task the second coordinate is sorted, so only a band is compared. Pairs within a block's
share are candidates; a pair counts in the first block where it is one, and is verified by the cosine of the
unrotated vectors in double precision. Links are counted and joined to trees in the task; pairs are not written.

A slab of more than ``CHUNK`` vectors is cut into chunks by hash, and every two chunks meet in a task of
their own, so no task holds more than two chunks.

Bit-equal vectors are one class with a multiplicity, so copies cost nothing.

Defined cases: vectors that are null, of length zero or hold null or non-finite components link with
nothing; vectors of different dimensions don't link; rows that share a ``vec_id`` are separate vectors that
link if their vectors do; ``component_id`` is the smallest ``vec_id`` reachable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import components
from fleetgauge.session import stored

COSINE = 0.95
BLOCKS = 8
CHUNK = 32768
TILE = 1024
SLACK = 1e-9


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(11).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[tuple[int, int]]:
    n = min(BLOCKS, dims)
    cuts = [dims * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def shares(dims: int, cosine: float) -> np.ndarray:
    """Squared-distance budget of each block, with room for rounding."""
    return np.array([(2 - 2 * cosine) * (b - a) / dims for a, b in blocks(dims)]) + SLACK


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of equal length as rows, and their dimension per row of the column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    return flat, sizes


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def classes(vectors: DataFrame) -> DataFrame:
    """``class, v, n``: the distinct usable vectors, as doubles, each with its number of rows; ``class`` its smallest id."""
    cleaned = vectors.withColumn("v", F.expr("""IF(embedding IS NULL OR size(embedding) = 0
        OR exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))
        OR NOT exists(embedding, x -> x <> 0), NULL, transform(embedding, x -> cast(x AS double) + 0D))"""))
    return cleaned.select("vec_id", "v")


def placements(known: DataFrame, cosine: float, chunk: int) -> DataFrame:
    """Every vector in its own slab and, as a partner, in the slab before: ``dims, block, slab, role, chunk, class, n, v``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _matrix(batch.column("v"))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                x = np.stack([flat[starts[r]:starts[r] + dims] for r in rows])
                turned = unit(x) @ rotation(int(dims))
                radius = np.sqrt(shares(int(dims), cosine))
                for b, (a, _) in enumerate(blocks(int(dims))):
                    slab = np.floor(turned[:, a] / radius[b]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), dims, np.int32)), pa.array(np.full(len(rows), b, np.int32)), pa.array(slab),
                         batch.column("class").take(pa.array(rows))], ["dims", "block", "slab", "class"])

    return known.select("class", "v").mapInArrow(place, "dims int, block int, slab int, class long")


def _solve(own: tuple, other: tuple | None, block: int, cosine: float):
    """Counts of linked rows per class and tree links among ``own``, or between ``own`` and ``other``."""
    ids, n, x, t = own
    ids2, n2, x2, t2 = own if other is None else other
    dims = x.shape[1]
    cuts, share = blocks(dims), shares(dims, cosine)
    a, b = cuts[block]
    line = min(a + 1, b - 1)
    order, order2 = np.argsort(t[:, line], kind="stable"), np.argsort(t2[:, line], kind="stable")
    p, p2 = t[order, a:b], t2[order2, a:b]
    sq, sq2 = np.einsum("ij,ij->i", p, p), np.einsum("ij,ij->i", p2, p2)
    key, key2 = t[order, line], t2[order2, line]
    radius = np.sqrt(share[block])
    same = other is None
    counts, counts2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
    shift = 0 if same else len(ids)
    label = np.arange(len(ids) + (0 if same else len(ids2)))
    for at in range(0, len(p), TILE):
        end = min(at + TILE, len(p))
        lo = at if same else np.searchsorted(key2, key[at] - radius)
        hi = np.searchsorted(key2, key[end - 1] + radius, side="right")
        for lo2 in range(lo, hi, 8 * TILE):
            hi2 = min(hi, lo2 + 8 * TILE)
            gap = p[at:end] @ p2[lo2:hi2].T
            gap *= -2
            gap += sq[at:end, None]
            gap += sq2[None, lo2:hi2]
            i, j = np.nonzero(gap <= share[block] + SLACK)
            i, j = i + at, j + lo2
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 17):
                r, s = order[i[k:k + (1 << 17)]], order2[j[k:k + (1 << 17)]]
                # by the same form in every block, so exactly one block owns a pair
                first = np.ones(len(r), bool)
                for e, (c, d) in enumerate(cuts[:block + 1]):
                    g = t[r, c:d] - t2[s, c:d]
                    first &= (np.einsum("ij,ij->i", g, g) <= share[e]) == (e == block)
                r, s = r[first], s[first]
                dot = np.einsum("ij,ij->i", x[r], x2[s])
                hit = dot / np.sqrt(np.einsum("ij,ij->i", x[r], x[r]) * np.einsum("ij,ij->i", x2[s], x2[s])) >= cosine
                r, s = r[hit], s[hit]
                counts += np.bincount(r, n2[s], len(ids)).astype(np.int64)
                counts2 += np.bincount(s, n[r], len(ids2)).astype(np.int64)
                u, w = r, s + shift
                while len(u):  # hook the larger root on the smaller until all these links lie within one tree
                    lu, lw = label[u], label[w]
                    open_ = lu != lw
                    u, w = u[open_], w[open_]
                    np.minimum.at(label, np.maximum(lu, lw)[open_], np.minimum(lu, lw)[open_])
                    while (up := label[label]).tobytes() != label.tobytes():
                        label = up
    every = ids if same else np.concatenate([ids, ids2])
    total = counts + counts2 if same else np.concatenate([counts, counts2])
    return every, total, every[label]


def _joined(pairs: DataFrame, cosine: float) -> DataFrame:
    """``class, links, other`` for each task's group ``(dims, block, slab, left, right)``."""

    def solve(key, table):
        dims, block = key[0].as_py(), key[1].as_py()
        flat = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        turned = unit(flat) @ rotation(dims)
        ids, n = table.column("class").to_numpy(), table.column("n").to_numpy()
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        mine = [(ids[m], n[m], flat[m], turned[m]) for m in (~second, second)]
        with_other = key[3].as_py() != key[5].as_py() or key[2].as_py() != key[4].as_py()
        if not len(mine[0][0]) or with_other and not len(mine[1][0]):
            every, total, root = ids[:0], n[:0], ids[:0]
        else:
            every, total, root = _solve(mine[0], mine[1] if with_other else None, block, cosine)
        some = total > 0
        return pa.table({"class": pa.array(every[some]), "links": pa.array(total[some]), "other": pa.array(root[some])})

    return pairs.groupBy("dims", "block", "slab", "left", "slab2", "right").applyInArrow(solve, "class long, links long, other long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, chunk: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``)."""
    size = CHUNK if chunk is None else chunk
    rows = stored(classes(vectors), "vectors")
    known = rows.where("v IS NOT NULL").groupBy("v").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first")).withColumn("class", F.xxhash64("v"))
    known = stored(known, "vector-classes")
    at = stored(placements(known, cosine, size), "vector-slabs")
    filled = stored(at.groupBy("dims", "block", "slab").agg(F.count(F.lit(1)).alias("held"))
                    .withColumn("chunks", F.expr(f"cast(ceil(held / {size}) AS int)")), "vector-chunks")
    mine = filled.select("dims", "block", "slab", "chunks")
    after = filled.selectExpr("dims", "block", "slab - 1 AS slab", "chunks AS after")
    before = filled.selectExpr("dims", "block", "slab + 1 AS slab", "chunks AS before")
    sized = mine.join(after, ["dims", "block", "slab"], "left").join(before, ["dims", "block", "slab"], "left")
    cut = at.join(sized, ["dims", "block", "slab"]).withColumn("chunk", F.expr("pmod(hash(class), chunks)"))
    # own slab: chunk pairs left <= right; next slab: every chunk with every one of this slab's
    roles = cut.selectExpr("dims", "block", "class", """inline(concat(
        transform(sequence(chunk, chunks - 1), c -> named_struct('slab', slab, 'left', chunk, 'slab2', slab, 'right', c, 'second', false)),
        IF(chunk = 0, array(), transform(sequence(0, chunk - 1), c -> named_struct('slab', slab, 'left', c, 'slab2', slab, 'right', chunk, 'second', true))),
        IF(after IS NULL, array(), transform(sequence(0, after - 1), c -> named_struct('slab', slab, 'left', chunk, 'slab2', slab + 1, 'right', c, 'second', false))),
        IF(before IS NULL, array(), transform(sequence(0, before - 1), c -> named_struct('slab', slab - 1, 'left', c, 'slab2', slab, 'right', chunk, 'second', true)))))""")
    found = stored(_joined(roles.join(known.select("class", "n", "v"), "class"), cosine), "vector-links")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = stored(components(found.selectExpr("class AS a", "other AS b")), "vector-roots")
    placed = known.join(counts, "class", "left").join(roots, known["class"] == roots.node, "left").selectExpr(
        "v", "first", "n - 1 + coalesce(links, 0) AS n_links", "coalesce(root, class) AS root")
    placed = stored(placed, "vector-members")
    lowest = placed.groupBy("root").agg(F.min("first").alias("component"))
    members = placed.join(lowest, "root").select("v", "n_links", "component")
    return rows.join(members, "v", "left").selectExpr(
        "vec_id", "coalesce(n_links, 0L) AS n_links", "coalesce(component, vec_id) AS component_id"
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
