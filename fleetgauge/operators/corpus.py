"""Requirement documents: front matter, sections, chunks.

One document is one row from the scan to the chunk list, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions import text as tx
from fleetgauge.functions.ids import stable_id
from fleetgauge.functions.sqltext import text, texts

MAX_CHUNK_CHARS = 1500
_STRIP = text(tx.WHITESPACE)


def _strip(x: str) -> str:
    return f"btrim({x}, {_STRIP})"


def front_matter(documents: DataFrame) -> DataFrame:
    """Adds ``fields`` (key/value pairs in order) and ``body`` to ``file_name, raw``."""
    pattern = text(v.FRONT_MATTER_PATTERN)
    key = _strip("substring_index(line, ':', 1)")
    value = _strip("substring(line, instr(line, ':') + 1)")
    quotes = text("\"'")
    return documents.selectExpr(
        "*", f"regexp_extract(raw, {pattern}, 0) AS _block", f"regexp_extract(raw, {pattern}, 1) AS _head",
    ).selectExpr(
        "* EXCEPT (_block, _head)",
        "transform(filter(split(_head, '\\n'), line -> contains(line, ':') "
        f"AND NOT startswith({_strip('line')}, '#')), line -> "
        f"named_struct('key', lower({key}), 'value', btrim({value}, {quotes}))) AS fields",
        "substring(raw, length(_block) + 1) AS body",
    )


def _field(name: str) -> str:
    """The last value given for a key."""
    return f"try_element_at(filter(fields, f -> f.key = '{name}'), -1).value"


def _lookup(pairs: dict[str, str], key: str, default: str) -> str:
    cases = " ".join(f"WHEN {text(k)} THEN {text(x)}" for k, x in pairs.items())
    return f"CASE {key} {cases} ELSE {text(default)} END"


def _list(name: str) -> str:
    return f"filter(split({_strip(f'coalesce({_field(name)}, {text('')})')}, '\\\\s*,\\\\s*'), x -> x <> '')"


def document_meta(parsed: DataFrame) -> DataFrame:
    """Typed metadata; unknown values fall back to the documented defaults."""
    kind = f"lower(coalesce({_field('document_type')}, {_field('source_type')}, 'manual'))"
    access = f"lower(coalesce({_field('access_level')}, 'internal'))"
    feature = f"upper(coalesce({_field('feature')}, ''))"
    date = _field("valid_from")
    return parsed.selectExpr(
        "*",
        f"coalesce(nullif({_field('title')}, ''), regexp_replace(file_name, '\\\\.[^.]*$', '')) AS title",
        "sha2(raw, 256) AS sha256",
        f"{_lookup(v.SOURCE_ALIASES, kind, 'manual')} AS source_type",
        f"nullif({_field('vehicle_platform')}, '') AS vehicle_platform",
        f"CASE WHEN {feature} IN ({texts(v.FEATURES)}) THEN {feature} END AS feature",
        f"nullif({_field('version')}, '') AS version",
        f"CASE WHEN {date} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN try_to_date({date}, 'yyyy-MM-dd') "
        f"WHEN {date} rlike '^[0-9]{{8}}$' THEN try_to_date({date}, 'yyyyMMdd') END AS valid_from",
        f"CASE WHEN {access} IN ({texts(v.ACCESS_LEVELS)}) THEN {access} ELSE 'internal' END AS access_level",
        f"{_list('related_signal_names')} AS doc_signals",
        f"{_list('related_scenario_ids')} AS doc_scenarios",
    ).withColumn("document_id", stable_id("doc", F.col("file_name"), F.col("sha256")))


def sections(body: str = "body") -> str:
    """SQL text: ARRAY of ``struct(heading, text)``; text before the first heading is Preamble."""
    pattern = text(v.HEADING_PATTERN)
    heads = f"concat(array('Preamble'), regexp_extract_all({body}, {pattern}, 2))"
    texts_ = f"split({body}, {pattern}, -1)"
    paired = (f"zip_with({heads}, {texts_}, (h, t) -> "
              f"named_struct('heading', {_strip('h')}, 'text', {_strip('t')}))")
    return f"filter({paired}, s -> s.text <> '')"


def split_long(column: str, max_chars: int = MAX_CHUNK_CHARS) -> str:
    """SQL text: ARRAY of pieces, paragraphs packed greedily; one long paragraph stays whole."""
    joined = f"IF(s.cur <> '', {_strip(f'concat(s.cur, {text(chr(10) * 2)}, p)')}, p)"
    start = "named_struct('done', CAST(array() AS ARRAY<STRING>), 'cur', '')"
    step = (f"IF(s.cur <> '' AND length({joined}) > {max_chars}, "
            "named_struct('done', array_append(s.done, s.cur), 'cur', p), "
            f"named_struct('done', s.done, 'cur', {joined}))")
    packed = (f"aggregate(split({column}, '\\\\n\\\\s*\\\\n', -1), {start}, (s, p) -> {step}, "
              "s -> IF(s.cur <> '', array_append(s.done, s.cur), s.done))")
    return f"IF(length({column}) <= {max_chars}, array({column}), {packed})"


def split_sections(parsed: DataFrame) -> DataFrame:
    return parsed.selectExpr("file_name", f"posexplode({sections()}) AS (section, item)").selectExpr(
        "file_name", "section", "item.heading AS heading", "item.text AS text")


CHUNK_COLUMNS = (
    "chunk_id", "document_id", "file_name", "document_title", "ordinal", "heading", "text", "source_type",
    "vehicle_platform", "feature", "version", "valid_from", "access_level", "related_signal_names",
    "related_scenario_ids", "requirement_ids",
)


def chunk_documents(
    documents: DataFrame, max_chars: int = MAX_CHUNK_CHARS, known_signals: tuple[str, ...] = v.SIGNALS
) -> DataFrame:
    """Chunks of ``file_name, raw`` documents; ``ordinal`` counts within the document."""
    meta = document_meta(front_matter(documents)).drop("raw", "fields")
    pieces = (f"flatten(transform({sections()}, sec -> transform({split_long('sec.text', max_chars)}, "
              "piece -> named_struct('heading', sec.heading, 'piece', piece))))")
    exploded = meta.selectExpr("* EXCEPT (body)", f"posexplode({pieces}) AS (ordinal, item)").selectExpr(
        "* EXCEPT (item)", "item.heading AS heading", "item.piece AS piece",
        "concat(item.heading, '\\n\\n', item.piece) AS text")
    vocabulary = F.concat("doc_signals", F.array(*[F.lit(s) for s in known_signals]))
    return (
        exploded.withColumns({
            "chunk_id": stable_id("chunk", F.col("document_id"), F.col("ordinal"), F.col("piece")),
            "requirement_ids": tx.requirement_ids(F.concat_ws(" ", "heading", "piece")),
            "related_signal_names": tx.terms_in(F.col("text"), vocabulary),
            "related_scenario_ids": F.expr(
                "IF(exists(doc_scenarios, s -> contains(text, s)), "
                "filter(doc_scenarios, s -> contains(text, s)), doc_scenarios)"),
        })
        .withColumnRenamed("title", "document_title")
        .select(*CHUNK_COLUMNS)
    )


def injection_scan(chunks: DataFrame) -> DataFrame:
    """``chunk_id, pattern, excerpt``, one row per match."""
    return chunks.selectExpr("chunk_id", f"inline({tx.injection_matches('text')})")


def corpus_summary(chunks: DataFrame) -> DataFrame:
    """Chunk counts by source, by access level and in total (``facet, value, chunks``).

    Documents are counted from their first chunk, which every chunked document has.
    """
    counted = chunks.groupBy("source_type", "access_level").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("ordinal") == 0).alias("documents"))
    facets = F.expr(
        "inline(array(named_struct('facet', 'source', 'value', source_type), "
        "named_struct('facet', 'access', 'value', access_level), "
        "named_struct('facet', 'all', 'value', 'all')))")
    return counted.select("chunks", "documents", facets).groupBy("facet", "value").agg(
        F.sum("chunks").alias("chunks"), F.sum("documents").alias("documents"))
