"""Removal of repeated 200-byte strings, by prefix doubling over names of sampled positions.

Positions are named by the string that starts there: equal names, equal strings. Names of 25 bytes are hashes; pairs of
names at offset 25, 50 and 100 name 50, 100 and 200 bytes. A plain run would sort a row for each byte of the corpus
in every round, many times the input. Here a round only sees positions that may still repeat:

1. Every 200-byte window is put down to one of the 50-byte names within it, the least by hash (the leftmost of
   equal ones). The choice depends on the window's bytes alone, so equal windows choose the same name at the same
   offset. Neighbouring windows mostly choose the same position; these are a run, one row for about 76 bytes. Runs
   whose 50-byte name is unique in the corpus hold no repeated window and drop out.
2. Runs that agree on the whole stretch their windows cover are repeated as a whole and settled.
3. Where one 50-byte name occurs in different stretches, one run per stretch goes on. Its windows fall into three
   parts, each with 150 bytes, the core, that all windows of the part hold; parts whose core no other stretch has drop out.
4. The windows of the other parts are named by doubling to 200 bytes, and names that occur twice are repeated.

Names are 64-bit hashes; in step 2 two together tell stretches apart. Cores only rule parts out, so 20 bits next to the
50-byte name do: equal strings have equal cores. Counts are combined before the shuffle, so a passage in a third of
the documents is no hot group.

Defined cases: null text is empty; texts under 200 bytes lose nothing; a repeated row counts as a further document, so
both lose what they share; the spans of a document are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import steps
from fleetgauge.llm.words import PLAIN, bytes_of, mix, powers, prefix
from fleetgauge.session import stored

SPAN = 200
GRAM = 50
#: Bytes looked at in one go; a longer text is cut, with an overlap of a window.
CHUNK = 1 << 22
#: Parts of a run by the place of its name in a window, 0 to 49, 50 to 99 and 100 to 150 bytes in; bits kept of their cores.
PARTS = 3
CORE_BITS = 20
PLACE = np.uint64((1 << 24) - 1)
_OTHER = np.uint64(0xA0761D6478BD642F)


def doubled(names: np.ndarray, offset: int) -> np.ndarray:
    """Names of twice the length, from pairs of names at this offset."""
    return mix(names[:-offset] * _OTHER + mix(names[offset:]))


def names_of(data: np.ndarray, size: int) -> np.ndarray:
    """Names of all strings of ``size`` = 25 * 2^k bytes."""
    up, down = powers(len(data) + 1)
    sums = prefix(PLAIN[data], up)
    names = mix((sums[25:] - sums[:-25]) * down[: len(data) - 24])
    length = 25
    while length < size:
        names = doubled(names, length)
        length *= 2
    return names


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    length = 1
    while 2 * length <= width:
        keys = np.minimum(keys[:-length], keys[length:])
        length *= 2
    return np.minimum(keys[: len(keys) - (width - length)], keys[width - length:])


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows: row, first window in the row, number, how far in the name is, 50-byte name, name of the stretch, cores."""
    if len(data) < SPAN:
        return *(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(3))
    grams = names_of(data, GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    least = _least(grams & ~PLACE | place, SPAN - GRAM + 1)
    at = (least & PLACE).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(at)]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    valid = np.arange(len(at)) + SPAN <= ends
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    edge = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid)
    count = edge - first + 1
    up, down = powers(len(data) + 1)
    sums = prefix(PLAIN[data], up)
    shape = (at[first] - first).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64)
    stretch = mix((sums[edge + SPAN] - sums[first]) * down[first] + shape * _OTHER)
    return rows[first], first - offsets[rows[first]], count, at[first] - first, grams[at[first]], stretch, _cores(grams, at[first])


def _cores(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits of the names of the 150 bytes from 0, 50 and 100 bytes before each place; parts without windows may hold anything."""
    packed = np.zeros(len(at), np.uint64)
    for part in range(PARTS):
        start = np.clip(at - part * GRAM, 0, len(grams) - 1 - 2 * GRAM)
        core = mix(grams[start] * _OTHER + mix(grams[start + GRAM] * _OTHER + mix(grams[start + 2 * GRAM])))
        packed |= core >> np.uint64(64 - CORE_BITS) << np.uint64(CORE_BITS * part)
    return packed


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Pieces that hold whole rows, or part of a long one: bytes, offsets, first row, place in that row."""
    if len(data) <= CHUNK:
        yield data, offsets, 0, 0
        return
    for row in range(len(offsets) - 1):
        for at in range(int(offsets[row]), int(offsets[row + 1]), CHUNK):
            part = data[at:min(at + CHUNK + SPAN - 1, int(offsets[row + 1]))]
            yield part, np.array([0, len(part)]), row, at - int(offsets[row])


def runs(docs: DataFrame) -> DataFrame:
    """``doc, first, many, inset, gram, stretch, cores``: see step 1. ``docs`` has ``doc`` (a long per row) and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch):
                ids = piece.column("doc").to_numpy()
                for data, offsets, row, place in _chunks(*bytes_of(piece.column("text"))):
                    rows, first, many, inset, *names = _runs(data, offsets)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[rows + row]), pa.array(first + place), pa.array(many.astype(np.int32)),
                         pa.array(inset.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in names)],
                        ["doc", "first", "many", "inset", "gram", "stretch", "cores"])

    return docs.select("doc", "text").mapInArrow(
        run, "doc long, first long, many int, inset int, gram long, stretch long, cores long")


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``body``, the compressed bytes of ``text``: whole texts go through two shuffles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor()
        for batch in batches:
            for piece in steps(batch):
                bodies = [coder.compress(text.as_py().encode()) for text in piece.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in keep), pa.array(bodies, pa.binary())], [*keep, "body"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(pack, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", body binary")


def _unpacked(body: pa.Scalar) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body.as_py()), np.uint8)


def parts(table: DataFrame) -> DataFrame:
    """``doc, first, many`` of the parts of runs (``gram, x`` with a run in ``x``) whose core occurs in two of them; see step 3."""
    # a window that starts o bytes before the name is in part o div 50, the last one with o = 150
    cut = table.selectExpr("gram", "x.*", f"explode(sequence(0, {PARTS - 1})) AS part").selectExpr(
        "gram", "doc", "part", f"shiftright(cores, {CORE_BITS} * part) & {(1 << CORE_BITS) - 1} AS core", "first", "inset",
        f"least(inset, IF(part = {PARTS - 1}, {SPAN - GRAM}, part * {GRAM} + {GRAM - 1})) AS far",
        f"greatest(inset - many + 1, part * {GRAM}) AS near").where("far >= near")
    cut = stored(cut.selectExpr("gram", "part", "core", "doc", "first + inset - far AS first", "far - near + 1 AS many"), "repeat-parts")
    several = cut.groupBy("gram", "part", "core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return cut.join(several, ["gram", "part", "core"], "left_semi").select("doc", "first", "many")


def _windows(data: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 200-byte names of the windows of the runs of one text."""
    places = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    names = np.empty(len(places), np.uint64)
    for at in range(0, len(data), CHUNK):
        mine = (places >= at) & (places < at + CHUNK)
        if mine.any():
            names[mine] = names_of(data[at:at + CHUNK + SPAN - 1], SPAN)[places[mine] - at]
    return places, names


def repeated_windows(texts: DataFrame) -> DataFrame:
    """``doc, place`` of repeated windows among the runs that ``texts`` (``doc, body, runs``) asks for.

    ``runs`` holds ``first, many``. The names meet by one shuffle and a sort; equal ones are neighbours.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, body, asked in zip(*(batch.column(c) for c in ("doc", "body", "runs"))):
                data = _unpacked(body)
                first, many = (asked.values.field(c).to_numpy().astype(np.int64) for c in ("first", "many"))
                places, names = _windows(data, first, many)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(np.full(len(places), doc.as_py())), pa.array(places)],
                    ["name", "doc", "place"])

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("name", "doc", "place")]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            same = rows[0][1:] == rows[0][:-1]
            hit = np.append(False, same) | np.append(same, False)
            # the last row waits for the next batch; with it goes the neighbour it equals, which is given already
            done = 1 if held is not None and len(held[0]) == 2 else 0
            yield out(rows, np.flatnonzero(hit[:-1])[0 if not done else int(hit[0]):])
            held = [x[-2:] if hit[-1] else x[-1:] for x in rows]
        if held is not None and len(held[0]) == 2:
            yield out(held, np.array([1]))

    def out(rows: list, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[1][at]), pa.array(rows[2][at])], ["doc", "place"])

    named = texts.select("doc", "body", "runs").mapInArrow(name, "name long, doc long, place long")
    placed = named.repartition("name").sortWithinPartitions("name")
    return placed.mapInArrow(equal, "doc long, place long")


def _removed(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[int, int, str]:
    """Bytes and merged spans that go, and the digest of what stays."""
    edges = np.zeros(len(data) + 1, np.int32)
    np.add.at(edges, first, 1)
    np.add.at(edges, stop, -1)
    gone = np.cumsum(edges[:-1]) > 0
    starts = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
    return int(gone.sum()), starts, hashlib.sha256(data[~gone].tobytes()).hexdigest()


def spans(docs: DataFrame) -> DataFrame:
    """``doc, first, stop``: stretches of bytes covered by repeated strings, not merged. ``docs`` has ``doc, text``."""
    again = runs(docs).groupBy("gram").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("gram")
    asked = runs(docs).join(stored(again, "repeat-names"), "gram", "left_semi")
    shared = stored(asked, "repeat-shared")
    kinds = stored(shared.groupBy("gram", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "first", "many", "inset", "cores")).alias("x")), "repeat-kinds")
    whole = kinds.where("n > 1").select("gram", "stretch")
    settled = shared.join(whole, ["gram", "stretch"], "left_semi").selectExpr("doc", "first", f"first + many + {SPAN - 1} AS stop")
    several = stored(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "repeat-several")
    one_each = kinds.join(several, "gram", "left_semi")
    wanted = stored(
        parts(one_each).groupBy("doc").agg(F.collect_list(F.struct("first", "many")).alias("runs")), "repeat-wanted")
    texts = packed(docs, "doc").join(wanted, "doc").dropDuplicates(["doc"])
    # the run that stands for a kind speaks for it: with n > 1 all runs of the kind are settled
    single = repeated_windows(texts).selectExpr("doc", "place AS first", f"place + {SPAN} AS stop")
    return settled.unionByName(single)


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs``."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))
    # a span as one long: where it begins, and its length, which is below 512, in the low bits
    coded = spans(keyed).selectExpr("doc", "shiftleft(first, 9) + (stop - first) AS span")
    gone = stored(coded.groupBy("doc").agg(F.collect_list("span").alias("spans")), "repeat-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch, "body"):
                sizes, got = [], []
                for body, found in zip(piece.column("body"), piece.column("spans")):
                    data = _unpacked(body)
                    none = np.zeros(0, np.int64)
                    codes = found.values.to_numpy() if found.is_valid else none
                    sizes.append(len(data))
                    got.append(_removed(data, codes >> 9, (codes >> 9) + (codes & 511)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([x[0] for x in got], pa.int64()),
                     pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.string())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = packed(keyed, "doc_id", "doc").join(gone, "doc", "left").select("doc_id", "body", "spans")
    return joined.mapInArrow(
        cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
