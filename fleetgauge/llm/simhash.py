"""SimHash near-duplicates by pigeonhole blocks.

A text is lower-cased (A-Z), cut into words at ASCII white space and into 3-word shingles; a
fingerprint bit is set if it is set in more than half of the shingles' XXH64 values. Fingerprints
link at ``DISTANCE`` or fewer differing bits.

The 64 bits are cut into six blocks. Two linked fingerprints differ in at most three blocks, so
they agree on three, and meet under one of 20 keys of 31 to 33 bits. Rows are distinct fingerprints,
so copies cost nothing beyond the first. Rows of a key lie together after one shuffle and a sort; a
task finds the links of a run of equal keys and writes a spanning tree of them, never all pairs. A run
longer than ``RUN`` rows is cut anew: its free 32 bits are split into six blocks again, which leaves
runs that agree on 46 or more bits. Those hold at most 2^18 different fingerprints by their very size
and are searched by looking up the near values of their free bits, so the work stays linear.

Defined cases: null or empty text has no words and fingerprint zero, linked like any other; fewer
than three words are one shingle; a repeated row gets a row each; the representative is the smallest
``doc_id`` of the component (nulls count last), and among rows that share it the smallest text hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import by_text, components
from fleetgauge.session import stored

DISTANCE = 3
RUN = 2048
SEED = 42
SHINGLE = 3


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: splits at \x20 and \x09-\x0D only, lowers A-Z only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - SHINGLE + 1].tolist()
    values = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:].tolist())), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the fingerprint as a signed long ``fp``; one row per row."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(x) for x in piece.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return by_text(docs, ["doc_id", "text"], run, f"doc_id {kind}, fp long")


def _bounds(bits: int, blocks: int = 6) -> list[tuple[int, int]]:
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def _masks(bits: int) -> list[int]:
    """One mask per choice of three of six blocks; any pair within three bits agrees under one of them."""
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in _bounds(bits)]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


MASKS = _masks(64)


def _spread(mask: int, narrow: int) -> int:
    """The bits of ``narrow`` on the set places of ``mask``, lowest first."""
    out = place = 0
    for at in range(64):
        if mask >> at & 1:
            out |= (narrow >> place & 1) << at
            place += 1
    return out


def _second(mask: int) -> list[int]:
    """The keys of a long run: the mask together with three of six blocks of its free bits."""
    free = ((1 << 64) - 1) ^ mask
    return [mask | _spread(free, m) for m in _masks(free.bit_count())]


SECOND = [m for mask in MASKS for m in _second(mask)]


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def keyed(values: DataFrame, masks: list[int], which: str) -> DataFrame:
    """``(which, key, fp)``: the fingerprint under the masks that the SQL array ``which`` numbers."""
    table = "array(" + ", ".join(f"{_long(m)}L" for m in masks) + ")"
    return values.selectExpr("fp", f"explode({which}) AS which").selectExpr(
        "which", f"fp & element_at({table}, which + 1) AS key", "fp")


def _tree(run: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the run, by breadth-first search over all of it."""
    left = run
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= DISTANCE
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                yield from ((at, x) for x in found)


def _tree_by_lookup(run: np.ndarray, free: int) -> Iterator[tuple[int, int]]:
    """Links of sorted ``run``, whose values differ in the ``free`` bits only: near values are looked up."""
    places = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
    for size in range(1, DISTANCE + 1):
        for chosen in combinations(places, size):
            near = run ^ np.bitwise_or.reduce(chosen)
            at = np.minimum(np.searchsorted(run, near), len(run) - 1)
            hit = (run[at] == near) & (run < near)
            yield from zip(run[hit], near[hit])


def _links(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Links ``(a, b)`` within each run of equal ``(which, key)`` of rows that lie together and sorted."""

    def solve(which: int, run: np.ndarray) -> Iterator[tuple[int, int]]:
        if len(run) <= RUN:
            yield from _tree(run)
        else:
            yield from _tree_by_lookup(np.sort(run), ((1 << 64) - 1) ^ masks[which])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in ("which", "key", "fp")]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns)]
            which, key, fp = columns
            new = np.flatnonzero((which[1:] != which[:-1]) | (key[1:] != key[:-1])) + 1
            last = new[-1] if len(new) else 0
            kept = [x[last:] for x in columns]
            yield from emit(which[:last], fp[:last], np.concatenate([[0], new])[: len(new)], last)
        if kept is not None:
            yield from emit(kept[0], kept[2], np.array([0]), len(kept[0]))

    def emit(which: np.ndarray, fp: np.ndarray, starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts[1:], end)
        values = fp.astype(np.int64).view(np.uint64)
        found: list[tuple[int, int]] = []
        for a, b in zip(starts, ends):
            if b - a > 1:
                for link in solve(int(which[a]), values[a:b]):
                    found.append(link)
                    if len(found) >= 65536:
                        yield batch_of(found)
                        found = []
        if found:
            yield batch_of(found)

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(found, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    placed = rows.repartition("which", "key").sortWithinPartitions("which", "key")
    return placed.mapInArrow(run, "a long, b long")


def links(values: DataFrame, run: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that span every component of near ones."""
    limit = RUN if run is None else run
    every = stored(keyed(values, MASKS, f"sequence(0, {len(MASKS) - 1})"), "simhash-keys")
    sizes = every.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = stored(sizes, "simhash-runs")
    short = every.join(sizes.where(f"n <= {limit}"), ["which", "key"], "left_semi")
    long = every.join(sizes.where(f"n > {limit}"), ["which", "key"], "left_semi")
    n = len(MASKS)
    again = keyed(long.withColumn("_which", F.col("which")).select("fp", "_which"), SECOND,
                  f"transform(sequence(0, {n - 1}), i -> _which * {n} + i)")
    return _links(short, MASKS).unionByName(_links(again, SECOND))


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``; ``component_id`` is the smallest ``doc_id`` of the component."""
    marked = stored(fingerprints(docs), "simhash")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("_first")), "simhash-classes")
    roots = stored(components(links(classes.select("fp"))), "simhash-roots")
    placed = classes.join(roots, classes.fp == roots.node, "left").selectExpr(
        "fp", "_first", "coalesce(root, fp) AS _root")
    lowest = placed.groupBy("_root").agg(F.min("_first").alias("component_id"))
    members = stored(placed.join(lowest, "_root").select("fp", "component_id"), "simhash-members")
    return marked.join(members, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with their own columns only.

    Rows that repeat the representative's id stay once. Rows without ``doc_id`` can't be told apart and all stay.
    """
    chosen = stored(
        near_groups(docs.where("doc_id IS NOT NULL")).where("doc_id = component_id").select("doc_id").distinct(), "simhash-kept")
    named = docs.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
