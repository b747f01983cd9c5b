"""Text expressions for documents and untrusted strings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions.sqltext import text as sql_literal

WHITESPACE = " \t\n\r\f\x0b"


def _all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def tokenize(text: Column) -> Column:
    """Keyword tokens; signal names and requirement ids survive as one token."""
    raw = _all_matches(F.lower(text), v.KEYWORD_TOKEN_PATTERN)
    return F.filter(F.transform(raw, lambda t: F.btrim(t, F.lit(".-"))), lambda t: F.length(t) > 1)


def embedding_tokens(text: Column) -> Column:
    return _all_matches(F.lower(text), v.EMBEDDING_TOKEN_PATTERN)


def neutralise(text: Column) -> Column:
    """Drop control characters (tab and newline stay) and break code fences."""
    return F.regexp_replace(F.regexp_replace(text, v.CONTROL_CHARS_PATTERN, ""), "```", "'''")


def requirement_ids(text: Column) -> Column:
    return F.array_distinct(_all_matches(text, "(?U)" + v.REQUIREMENT_PATTERN))


def terms_in(text: Column, vocabulary: Column) -> Column:
    """Vocabulary entries that occur anywhere in the text, in vocabulary order."""
    return F.filter(F.array_distinct(vocabulary), lambda s: F.contains(text, s))


def is_stale(valid_from: Column, today: dt.date, stale_after_days: int) -> Column:
    """Older than the limit; undated documents never are."""
    age = F.datediff(F.lit(today), valid_from)
    return F.coalesce(age > F.lit(stale_after_days), F.lit(False))


def access_up_to(level: str) -> tuple[str, ...]:
    return v.ACCESS_LEVELS[: v.ACCESS_LEVELS.index(level) + 1]


def access_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in v.ACCESS_LEVELS]), level)


def citation(title: Column, heading: Column, chunk_id: Column) -> Column:
    return F.format_string("%s > %s (%s)", title, heading, chunk_id)


def real_world_language(text: Column) -> Column:
    return F.rlike(text, F.lit("(?iU)" + v.REAL_WORLD_PATTERN))


def observation_ids(text: Column) -> Column:
    return _all_matches(text, v.OBSERVATION_ID_PATTERN)


def report_ids(text: Column) -> Column:
    return _all_matches(text, v.REPORT_ID_PATTERN)


def injection_matches(text: str) -> str:
    """SQL text: ARRAY of ``struct(pattern, excerpt)``, one per match in the column ``text``.

    The text is cut at the matches, so the running length of pieces and matches gives every
    match's place without any offset function. Excerpts reach 40 characters to both sides.
    """
    found = []
    for name, pattern in v.INJECTION_PATTERNS.items():
        regex = sql_literal("(?iUd)" + pattern)
        hits = f"regexp_extract_all({text}, {regex}, 0)"
        pieces = f"split({text}, {regex}, -1)"
        run = "aggregate(slice({0}, 1, {1}), 0, (n, p) -> n + length(p))"
        start = f"({run.format(pieces, 'i + 1')} + {run.format(hits, 'i')})"
        excerpt = (f"substring({text}, greatest({start} - 40, 0) + 1, "
                   f"least({start}, 40) + length(hit) + 40)")
        item = f"named_struct('pattern', '{name}', 'excerpt', translate({excerpt}, '\n', ' '))"
        found.append(f"IF({text} rlike {regex}, transform({hits}, (hit, i) -> {item}), array())")
    return f"concat({', '.join(found)})"
