"""Expressions on telemetry signals, as SQL text over column names or sub-expressions."""

from __future__ import annotations

from fleetgauge.functions.sqltext import num

SEGMENT_WINDOW = "PARTITION BY file_id, seg ORDER BY row"


def ttc(gap: str, rel_v: str, closing_floor: float) -> str:
    """Gap over closing speed, null unless the ego closes faster than the floor."""
    return f"CASE WHEN -{rel_v} > {num(closing_floor)} THEN {gap} / (-{rel_v}) END"


def smooth_centered(x: str, k: int, window: str = SEGMENT_WINDOW) -> str:
    """Centred moving average over ``k`` samples, shorter at the ends, nulls ignored."""
    return f"avg({x}) OVER ({window} ROWS BETWEEN {k // 2} PRECEDING AND {(k - 1) // 2} FOLLOWING)"


def difference(t: str, window: str = SEGMENT_WINDOW) -> str:
    return f"{t} - lag({t}) OVER ({window})"


def gradient(y: str, t: str, window: str = SEGMENT_WINDOW) -> str:
    """dy/dt, second order on uneven spacing inside, one-sided at both ends."""
    y0, y1 = f"lag({y}) OVER ({window})", f"lead({y}) OVER ({window})"
    t0, t1 = f"lag({t}) OVER ({window})", f"lead({t}) OVER ({window})"
    back, ahead = f"({t} - {t0})", f"({t1} - {t})"
    return (
        f"CASE WHEN {t0} IS NULL AND {t1} IS NULL THEN NULL "
        f"WHEN {t0} IS NULL THEN ({y1} - {y}) / {ahead} "
        f"WHEN {t1} IS NULL THEN ({y} - {y0}) / {back} "
        f"ELSE ({back} * {back} * {y1} + ({ahead} * {ahead} - {back} * {back}) * {y} "
        f"- {ahead} * {ahead} * {y0}) / ({back} * {ahead} * ({ahead} + {back})) END"
    )


def threshold_verdict(value: str, comparator: str | None, threshold: str | None) -> str:
    """True/false against the threshold; null without threshold or value."""
    if comparator is None or threshold is None:
        return "CAST(NULL AS BOOLEAN)"
    if comparator not in ("<=", ">=", "=="):
        raise ValueError(f"unknown comparator {comparator!r}")
    return f"({value} {comparator} {threshold})"


def format_value(value: str, flag: str | None = None) -> str:
    """Display text: dash for missing, yes/no for flags, otherwise three decimals."""
    flags = f"WHEN {flag} THEN 'yes' WHEN NOT {flag} THEN 'no' " if flag else ""
    return (
        f"CASE {flags}WHEN {value} IS NULL THEN '—' WHEN abs({value}) = double('infinity') THEN 'inf' "
        f"ELSE format_string('%.3f', {value}) END"
    )
