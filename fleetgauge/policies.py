"""Tunable limits. Each policy becomes plan literals; its JSON text feeds evidence ids."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from fleetgauge import vocab as v


class _JsonPolicy:
    def to_json(self) -> str:
        return json.dumps(asdict(self), separators=(",", ":"))


@dataclass(frozen=True)
class QualityPolicy(_JsonPolicy):
    critical_signals: tuple[str, ...] = v.CRITICAL_SIGNALS
    optional_signals: tuple[str, ...] = v.OPTIONAL_SIGNALS
    min_rows: int = 20
    min_duration_s: float = 2.0
    gap_factor: float = 2.5
    max_missing_time_fraction: float = 0.10
    max_nan_fraction: float = 0.05
    max_plausible_speed_mps: float = 90.0
    max_plausible_distance_m: float = 500.0
    max_plausible_accel_mps2: float = 20.0


@dataclass(frozen=True)
class AebThresholds(_JsonPolicy):
    trigger_ttc_s: float = 2.0
    max_braking_latency_s: float = 0.30
    min_acceptable_ttc_s: float = 0.5
    collision_gap_m: float = 0.10
    detection_confidence_threshold: float = 0.5
    max_deceleration_mps2: float = 10.0
    max_comfort_jerk_mps3: float = 30.0
    closing_speed_floor_mps: float = 0.5
    window_pre_s: float = 5.0
    window_post_s: float = 5.0
    jerk_smoothing_samples: int = 5


@dataclass(frozen=True)
class RetrievalWeights:
    vector: float = 0.6
    keyword: float = 0.4
    trust_boost: float = 0.10
    stale_penalty: float = 0.15
    stale_after_days: int = 365


@dataclass(frozen=True)
class RetrievalFilters:
    """Least access by default; ``None`` means "no restriction" for the other filters."""

    allowed_access: tuple[str, ...] = ("public",)
    feature: str | None = None
    source_types: tuple[str, ...] | None = None
    vehicle_platform: str | None = None


@dataclass(frozen=True)
class ReleaseThresholds:
    max_unsupported_claim_rate: float = 0.10
    min_evidence_support_rate: float = 0.90
    min_top1_accuracy: float | None = None
    max_false_fault_rate: float | None = None
