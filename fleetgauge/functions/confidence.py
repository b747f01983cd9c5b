"""Confidence labels on an ordinal scale: blocked < low < medium < high."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge import vocab as v


def ordinal(label: str) -> int:
    return v.CONFIDENCE_ORDER.index(label)


def level_of(label: Column) -> Column:
    """0..3, null for an unknown label."""
    place = F.array_position(F.array(*[F.lit(c) for c in v.CONFIDENCE_ORDER]), label)
    return F.when(place > 0, (place - 1).cast("int"))


def label_of(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in v.CONFIDENCE_ORDER]), level + 1)


def band_level(score: Column) -> Column:
    return F.when(score >= 0.7, F.lit(3)).when(score >= 0.4, F.lit(2)).otherwise(F.lit(1))


def capped(level: Column, ceiling: str, when: Column) -> Column:
    return F.when(when, F.least(level, F.lit(ordinal(ceiling)))).otherwise(level)
