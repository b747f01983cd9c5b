"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

The documents of a source are numbered in the order of their hashed id and cut into blocks of
``BLOCK``. A target weight becomes a quota of about ``FRAME`` times the weight, one at least: in a
frame of F = sum of quotas slots, a source with quota q places q blocks. Block j of a frame may not
start before slot ``floor(j F / q)`` (release) and must be placed by slot ``ceil((j + 1) F / q)``
(deadline); of the released blocks the one with the earliest deadline gets the slot (ties: the
source that sorts first). So at every slot each source deviates from its share by less than one block.

A source takes part in as many whole frames as its blocks fill. When one can't fill a further frame, the
frames after it (the next phase) are those of the other sources, by the same quotas. What each source has
left after its last whole frame, less than a quota, makes up one closing frame, with the counts left as
quotas. Every row gets exactly one place; none is repeated or left out.

A phase needs the schedule of one frame only, since all are alike; it is computed from the table of
sources, not from documents. Numbering is done in 4096 buckets of the hashed id, so a source with a
third of the rows is no single task.

Defined cases: a null source is a source of its own; null ids sort first; equal ids share the order
of their rows arbitrarily, as their places differ but their content is numbered alike; more than
``SOURCES`` sources raise an error, as a table of target weights is meant to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.operators.segments import ranked
from fleetgauge.session import stored

BLOCK = 16
FRAME = 1000
SOURCES = 1000


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def numbered(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as ``_row``, with ``_source`` and the place ``_rank`` in the source, from 0."""
    order = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), source_key().alias("_source"), order.alias("_order"))
    bucket = F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")
    return ranked(keyed, ["_source"], [F.col("_order"), F.col("_row.doc_id")], F.coalesce(bucket, F.lit(-1)), "_rank").drop("_order")


def quotas(counts: DataFrame, weights: DataFrame | None) -> DataFrame:
    """One row per source: ``_source, blocks, quota, frames, rest``.

    ``weights`` has ``source, weight``; without it the target weight goes with the square root of
    the source's size, which lets small sources speak up. A source without weight gets quota one.
    """
    if weights is None:
        aimed = counts.withColumn("_w", F.sqrt("n"))
    else:
        named = weights.select(source_key().alias("_source"), F.col("weight").cast("double").alias("_w"))
        aimed = counts.join(named.groupBy("_source").agg(F.max("_w").alias("_w")), "_source", "left")
    return aimed.withColumn("_all", F.expr("sum(_w) OVER ()")).selectExpr(
        "_source", f"cast(ceil(n / {BLOCK}) AS long) AS blocks", f"cast(floor(n / {BLOCK}) AS long) AS whole",
        f"cast(greatest(1, round({FRAME} * coalesce(_w / _all, 0D))) AS long) AS quota",
    ).selectExpr("_source", "blocks", "quota", "floor(whole / quota) AS frames",
                 "blocks - quota * floor(whole / quota) AS rest")


_EDF = """
aggregate(sequence(0L, slots - 1),
    named_struct('done', transform(part, x -> 0L), 'picks', cast(array() AS array<int>)),
    (acc, t) -> transform(array(
        array_min(transform(part, (x, i) -> IF(
            acc.done[i] < x.quota AND acc.done[i] * slots <= t * x.quota,
            named_struct('deadline', cast(ceil((acc.done[i] + 1) * slots / x.quota) AS long), 'i', i), NULL))).i),
        pick -> named_struct('done', transform(acc.done, (d, i) -> IF(i = pick, d + 1, d)),
            'picks', array_append(acc.picks, pick)))[0],
    acc -> acc.picks)"""


def frames(sources: DataFrame) -> DataFrame:
    """The schedule of one frame of each phase: ``_source, phase, j, slot, slots, first_frame, base, quota``.

    Row j is the j-th block of the source in a frame of ``slots`` slots. ``phase`` is the number of
    whole frames at the phase's end, null for the closing frame; ``base`` the slots before the phase.
    """
    whole = sources.agg(F.array_sort(F.collect_list(F.struct("_source", "blocks", "quota", "frames", "rest"))).alias("every"))
    ends = whole.withColumn("_many", F.expr(f"IF(size(every) > {SOURCES}, raise_error('too many sources to mix'), NULL)"))
    ends = ends.selectExpr("every", "array_sort(array_distinct(filter(transform(every, x -> x.frames), f -> f > 0))) AS ends")
    phases = ends.selectExpr("every", "ends", """explode(concat(transform(ends, (e, i) -> named_struct(
        'phase', e, 'first_frame', IF(i = 0, 0L, get(ends, i - 1)))), array(named_struct('phase', cast(NULL AS long), 'first_frame', cast(NULL AS long))))) AS p""")
    parts = phases.selectExpr("every", "p.*", """IF(p.phase IS NULL,
        transform(filter(every, x -> x.rest > 0), x -> named_struct('_source', x._source, 'quota', x.rest)),
        transform(filter(every, x -> x.frames >= p.phase), x -> named_struct('_source', x._source, 'quota', x.quota))) AS part""")
    sized = parts.where("size(part) > 0").selectExpr(
        "phase", "first_frame", "part", "aggregate(part, 0L, (a, x) -> a + x.quota) AS slots",
        # slots before the phase: each source has placed the blocks of its whole frames up to there
        "aggregate(every, 0L, (a, x) -> a + x.quota * least(x.frames, coalesce(first_frame, x.frames))) AS base")
    placed = sized.selectExpr("phase", "first_frame", "part", "slots", "base", f"posexplode({_EDF}) AS (slot, pick)")
    return placed.selectExpr(
        "part[pick]._source AS _source", "part[pick].quota AS quota", "phase", "first_frame", "base", "slots",
        "cast(slot AS long) AS slot",
        "cast(row_number() OVER (PARTITION BY phase, pick ORDER BY slot) - 1 AS long) AS j")


def schedule(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``_source, _block, _offset, _slot, _release, _deadline`` (slots count from 0 over the whole mix)."""
    ranks = stored(numbered(docs), "mix-ranks")
    sources = stored(quotas(ranks.groupBy("_source").agg(F.count(F.lit(1)).alias("n")), weights), "mix-sources")
    slots = stored(frames(sources), "mix-frames")
    bounds = sources.agg(F.array_sort(F.collect_set(F.when(F.col("frames") > 0, F.col("frames")))).alias("ends"))
    mine = sources.join(F.broadcast(bounds), F.lit(True)).select("_source", "quota", "frames", "ends")  # one row on the right
    blocks = ranks.join(mine, "_source").selectExpr(
        "_row", "_source", f"_rank div {BLOCK} AS _block", f"_rank % {BLOCK} AS _offset",
        "quota AS _quota", f"(_rank div {BLOCK}) div quota AS _frame",
        f"IF((_rank div {BLOCK}) div quota < frames, element_at(filter(ends, e -> e > (_rank div {BLOCK}) div quota), 1), NULL) AS _phase",
        f"IF((_rank div {BLOCK}) div quota < frames, (_rank div {BLOCK}) % quota, _rank div {BLOCK} - quota * frames) AS _j")
    at = slots.selectExpr("_source AS _s", "coalesce(phase, -1L) AS _p", "j", "slot", "slots", "base", "first_frame", "quota")
    joined = blocks.join(at, (F.col("_source") == F.col("_s")) & (F.coalesce("_phase", F.lit(-1)) == F.col("_p")) & (F.col("_j") == F.col("j")))
    start = "base + coalesce(_frame - first_frame, 0L) * slots"
    return joined.selectExpr(
        "_row.*", "_source", "_block", "_offset", f"{start} + slot AS _slot",
        f"{start} + (j * slots) div quota AS _release",
        f"{start} + cast(ceil((j + 1) * slots / quota) AS long) AS _deadline")


def mixed(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, with their own columns only."""
    return schedule(docs, weights).orderBy("_slot", "_offset").select(*docs.columns)
