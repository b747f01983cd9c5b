"""Literals for SQL expression text.

Wide expression tables (gates, metrics, rule logs) are written as Spark SQL text: one parsed
expression instead of hundreds of small calls into the JVM, and the same plan.
"""

from __future__ import annotations


def num(x: float) -> str:
    """DOUBLE literal; a bare ``0.3`` would be a DECIMAL."""
    return f"{float(x)!r}D"


def text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(items) -> str:
    return ", ".join(text(i) for i in items)


def compact(*cases: tuple[str, str]) -> str:
    """ARRAY of the values whose condition holds, in order."""
    items = ", ".join(f"CASE WHEN {condition} THEN {value} END" for condition, value in cases)
    return f"array_compact(array({items}))"
