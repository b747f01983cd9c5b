"""Skew-proof building blocks for long logs.

One log may hold a large share of all samples, so nothing here puts a whole log into one
window partition. A log is cut into segments of ``SEGMENT_ROWS`` consecutive rows; windows run
per ``(file_id, seg)``. Where a window frame has to look over a segment edge, the few rows at
the edge are copied into the neighbouring segment (``is_halo``) and dropped afterwards, which
gives the same values as a window over the whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.session import stored

SEGMENT_ROWS = 1 << 17
TIME_BIN_S = 8.0


def segment_of(row: Column, segment_rows: int = SEGMENT_ROWS) -> Column:
    return F.floor(row / F.lit(segment_rows))


def with_halo(df: DataFrame, halo: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds ``seg`` and ``is_halo``; edge rows appear once more in the next segment."""
    own = segment_of(F.col("row"), segment_rows)
    place = F.col("row") % segment_rows
    targets = F.array_compact(F.array(
        own,
        F.when((place < halo) & (own > 0), own - 1),
        F.when(place >= segment_rows - halo, own + 1),
    ))
    return df.withColumn("seg", F.explode(targets)).withColumn("is_halo", F.col("seg") != own)


def segment_frame() -> Window:
    return Window.partitionBy("file_id", "seg").orderBy("row")


def ranked(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str
) -> DataFrame:
    """0-based ``row_number`` per key, computed bucket by bucket.

    ``bucket`` must not decrease along ``order``. The rows of one key are numbered inside each
    bucket and shifted by the number of rows in the buckets before it, so a key that holds a
    third of the table is spread over as many tasks as it has buckets.
    """
    src = df.withColumn("_bucket", bucket)
    sizes = src.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    placed = src.withColumn("_place", F.row_number().over(local))
    return (
        placed.join(shifts, [*keys, "_bucket"])
        .withColumn(name, (F.col("_shift") + F.col("_place") - 1).cast("bigint"))
        .drop("_bucket", "_place", "_shift")
    )


def ranked_by_range(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """0-based ``row_number`` per key where no bucket of the order is known beforehand.

    Rows are dealt into ranges of (keys, order), whose borders Spark finds by a bounded sample. They are numbered inside each
    range and shifted by the key's rows in the ranges before it. Ranges are of like size whatever values are frequent, as the
    order goes down to single rows; only rows equal in all of the order share a range.
    """
    # the sample is a pass of its own, so what is ranked is computed beforehand
    source = stored(df, "unranked")
    dealt = stored(source.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    local = Window.partitionBy(*keys, "_range").orderBy(*order)
    placed = dealt.withColumn("_place", F.row_number().over(local)).join(shifts, [*keys, "_range"])
    return placed.withColumn(name, (F.col("_shift") + F.col("_place") - 1).cast("bigint")).drop("_range", "_place", "_shift")


RADIX = 4096
#: Distinct values that one window ranks.
FEW_VALUES = 1 << 16


def order_values(counts: DataFrame, key: str, value: str, n: str, ranks: dict[str, str]) -> DataFrame:
    """Exact order statistics per key from pre-counted values ``(key, value, n)``; nulls don't count.

    ``ranks`` maps output columns to SQL for a 0-based rank in terms of ``total``. Each rank has a range of values that holds it,
    all of the key's at first. While a range has more than FEW_VALUES distinct values, it is cut into RADIX slices, the values are counted
    per slice (combined before the shuffle) and the slice that holds the rank becomes the range, so ranges shrink
    whatever the values are. Only then are the values of a range ranked. No window ever has more than
    FEW_VALUES rows, even if one key is the whole table.
    """
    src = stored(counts.where(f"{value} IS NOT NULL").select(key, F.col(value).alias("_v"), F.col(n).alias("_n")), "value-counts")
    wanted = ", ".join(f"named_struct('_out', '{out}', '_rank', CAST({sql} AS BIGINT))" for out, sql in ranks.items())
    ranges = stored(
        src.groupBy(key).agg(F.sum("_n").alias("total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_size"))
        .selectExpr(key, "_lo", "_hi", "_size", "0L AS _start", f"inline(array({wanted}))"), "value-ranges")

    def inside(wide: DataFrame) -> DataFrame:
        return src.join(wide, key).where("_v BETWEEN _lo AND _hi")

    settled = []
    while True:
        settled.append(ranges.where(f"_size <= {FEW_VALUES}"))
        wide = ranges.where(f"_size > {FEW_VALUES}")
        if wide.isEmpty():
            break
        slices = inside(wide).withColumn("_slice", F.expr(f"least({RADIX - 1}, floor((_v - _lo) / (_hi - _lo) * {RADIX}))"))
        sums = slices.groupBy(key, "_out", "_rank", "_start", "_slice").agg(
            F.sum("_n").alias("_sum"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_size"))
        before = Window.partitionBy(key, "_out").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # RADIX rows at most
        ranges = stored(
            sums.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_sum").over(before), F.lit(0)))
            .where("_rank >= _start AND _rank < _start + _sum").select(*ranges.columns), "value-ranges")
    done = settled[0]
    for part in settled[1:]:
        done = done.unionByName(part)
    upto = Window.partitionBy(key, "_out").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = inside(done).withColumn("_first", F.col("_start") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    hits = placed.where("_rank >= _first AND _rank < _first + _n")
    return hits.groupBy(key).agg(*[F.max(F.when(F.col("_out") == out, F.col("_v"))).alias(out) for out in ranks])


def exact_median(counts: DataFrame, key: str, value: str, n: str, out: str) -> DataFrame:
    """Interpolating median."""
    middle = {"_low": "floor((total - 1) / 2)", "_high": "floor(total / 2)"}
    return order_values(counts, key, value, n, middle).selectExpr(key, f"(_low + _high) / 2 AS {out}")


def time_bin(t: Column) -> Column:
    return F.floor(t / TIME_BIN_S)


def explode_bins(df: DataFrame, lo: Column, hi: Column, block: int = 1 << 16) -> DataFrame:
    """One row per time bin ``tbin`` that ``[lo, hi]`` touches, for joins on ``(file_id, tbin)``.

    Exploded in two steps, blocks then bins, so a years-long range never sits in one array.
    """
    first, last = time_bin(F.col("_lo")), time_bin(F.col("_hi"))
    start = F.col("_block") * block
    return (
        df.withColumns({"_lo": lo, "_hi": hi})
        .withColumn("_block", F.explode(F.sequence(F.floor(first / block), F.floor(last / block))))
        .withColumn("tbin", F.explode(F.sequence(
            F.greatest(first, start), F.least(last, start + (block - 1)))))
        .drop("_lo", "_hi", "_block")
    )
