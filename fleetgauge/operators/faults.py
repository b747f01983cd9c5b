"""Fault injection on clean logs: gap, then null burst, then dropped columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.operators import segments as sg


@dataclass(frozen=True)
class Faults:
    drop_columns: tuple[str, ...] = ()
    timestamp_gap: tuple[float, float] | None = None  # start_s, duration_s
    nan_burst: tuple[str, float, float] | None = None  # signal, start_s, duration_s

    def __post_init__(self) -> None:
        unknown = [c for c in self.drop_columns if c not in v.SIGNALS]
        if unknown or v.TIMESTAMP in self.drop_columns:
            raise ValueError(f"columns cannot be dropped: {unknown or [v.TIMESTAMP]}")
        if self.nan_burst and self.nan_burst[0] not in v.SIGNALS:
            raise ValueError(f"unknown signal {self.nan_burst[0]!r}")


def _inside(start: float, duration: float):
    t = F.col(v.TIMESTAMP)
    return F.coalesce((t >= start) & (t < start + duration), F.lit(False))


def timestamp_gap(telemetry: DataFrame, start_s: float, duration_s: float) -> DataFrame:
    """Remove the samples in ``[start, start+duration)`` and renumber the rest."""
    kept = telemetry.filter(~_inside(start_s, duration_s)).withColumnRenamed("row", "_old")
    return sg.ranked(
        kept, ["file_id"], [F.col("_old")], sg.segment_of(F.col("_old")), "row").drop("_old")


def nan_burst(telemetry: DataFrame, signal: str, start_s: float, duration_s: float) -> DataFrame:
    hit = _inside(start_s, duration_s)
    return telemetry.withColumn(signal, F.when(~hit, F.col(signal)))


def drop_columns(telemetry: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    kinds = dict(telemetry.dtypes)
    return telemetry.withColumns({c: F.lit(None).cast(kinds[c]) for c in columns})


def apply_faults(
    telemetry: DataFrame, provenance: DataFrame, faults: Faults
) -> tuple[DataFrame, DataFrame]:
    out, files = telemetry, provenance
    if faults.timestamp_gap:
        out = timestamp_gap(out, *faults.timestamp_gap)
    if faults.nan_burst:
        out = nan_burst(out, *faults.nan_burst)
    if faults.drop_columns:
        out = drop_columns(out, faults.drop_columns)
        files = files.withColumn(
            "present", F.array_except("present", F.array(*[F.lit(c) for c in faults.drop_columns])))
    return out, files
