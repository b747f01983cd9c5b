"""Verification of cited evidence and the confidence rules.

Tables are long: one row per citation, per hypothesis, per rule hit. A run or hypothesis with
very many citations is never gathered into one row; lists appear only where their length is
bounded by the vocabulary (evidence sources, failure classes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions import confidence as cf
from fleetgauge.functions import text as tx
from fleetgauge.functions.ids import stable_id
from fleetgauge.functions.sqltext import text, texts
from fleetgauge.operators.segments import ranked_by_range

NOT_A_SOURCE = ("file", "quality")
PART_ROWS = 1 << 18
OUTPUT_SCHEMA = (
    "observations ARRAY<STRING>, hypotheses ARRAY<STRUCT<cause STRING, failure_class STRING, "
    "evidence_ids ARRAY<STRING>, confidence DOUBLE>>, missing_evidence ARRAY<STRING>, "
    "recommended_next_tests ARRAY<STRING>, _corrupt STRING"
)
FENCE_PATTERN = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"


# The parser stops behind the first value. Only a body that is one whole value is valid both in a list and in an object.
WHOLE_JSON = (
    "IF(try_parse_json(concat('{\"one\":', _body, '}')) IS NOT NULL "
    "AND try_variant_get(try_parse_json(concat('[', _body, ']')), '$[1]', 'variant') IS NULL, "
    "try_variant_get(try_parse_json(concat('[', _body, ']')), '$[0]', 'variant'), NULL)"
)


# --- raw model output ------------------------------------------------------------------------


def parse_agent_outputs(raw: DataFrame) -> DataFrame:
    """``run_id, raw`` to typed output plus ``rejected`` (null when accepted).

    One surrounding code fence is tolerated. Anything that is not an object of the agreed shape
    is rejected whole: single quotes, text behind the object, and fields that are null or of another JSON type.
    Fields may be left out.
    """
    def list_of_texts(doc: str, field: str, typed: str) -> str:
        shape = f"schema_of_variant(try_variant_get({doc}, '$.{field}', 'variant'))"
        return f"(coalesce({shape}, 'ARRAY<STRING>') NOT IN ('ARRAY<STRING>', 'ARRAY<VOID>') OR exists(coalesce({typed}, array()), x -> x IS NULL))"

    def type_of(doc: str, field: str) -> str:
        return f"schema_of_variant(try_variant_get({doc}, '$.{field}', 'variant'))"

    lists = " OR ".join(list_of_texts("_doc", f, f"output.{f}") for f in ("observations", "missing_evidence", "recommended_next_tests"))
    bad_types = (
        f"{type_of('j', 'cause')} <> 'STRING' OR coalesce({type_of('j', 'failure_class')}, 'STRING') <> 'STRING' "
        f"OR NOT ({type_of('j', 'confidence')} IN ('BIGINT', 'DOUBLE') OR {type_of('j', 'confidence')} LIKE 'DECIMAL%') "
        f"OR {list_of_texts('j', 'evidence_ids', 'cast(null AS array<string>)')} "
        "OR exists(coalesce(try_variant_get(j, '$.evidence_ids', 'array<string>'), array()), x -> x IS NULL)"
    )
    fence = text(FENCE_PATTERN)
    parsed = raw.withColumn("_body", F.expr(
        f"IF(raw rlike {fence}, regexp_extract(raw, {fence}, 1), raw)"
    )).withColumn("output", F.from_json(
        "_body", OUTPUT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"},
    )).withColumn("_doc", F.expr(WHOLE_JSON))
    bad_item = (
        "h IS NULL OR h.cause IS NULL OR h.cause = '' OR h.confidence IS NULL OR h.confidence < 0 "
        f"OR h.confidence > 1 OR coalesce(h.failure_class, 'unknown') NOT IN ({texts(v.FAILURE_CLASSES)})"
    )
    rejected = (
        r"CASE WHEN NOT coalesce(_body rlike '(?s)^\\s*\\{.*\\}\\s*$', false) OR output IS NULL "
        "OR output._corrupt IS NOT NULL OR _doc IS NULL THEN 'model output is not JSON of the agreed shape' "
        f"WHEN {lists} OR coalesce({type_of('_doc', 'hypotheses')}, 'ARRAY<') NOT LIKE 'ARRAY<%' "
        f"OR exists(coalesce(output.hypotheses, array()), h -> coalesce({bad_item}, true)) "
        f"OR exists(coalesce(try_variant_get(_doc, '$.hypotheses', 'array<variant>'), array()), j -> coalesce({bad_types}, true)) "
        "THEN 'model output does not match the schema' END"
    )
    return parsed.selectExpr(
        "run_id", f"{rejected} AS rejected",
        "coalesce(output.observations, array()) AS observations",
        "transform(coalesce(output.hypotheses, array()), h -> named_struct('cause', h.cause, "
        "'failure_class', coalesce(h.failure_class, 'unknown'), "
        "'evidence_ids', coalesce(h.evidence_ids, array()), 'confidence', h.confidence)) AS hypotheses",
        "coalesce(output.missing_evidence, array()) AS missing_evidence",
        "coalesce(output.recommended_next_tests, array()) AS recommended_next_tests",
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("rejected IS NULL").drop("rejected")


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.filter("rejected IS NOT NULL").select("run_id", "rejected")


def explode_hypotheses(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted outputs to the long form: hypotheses and citations keyed by ``hyp_key``."""
    rows = outputs.selectExpr("run_id", "posexplode(hypotheses) AS (hypothesis_index, h)").withColumn(
        "hyp_key", stable_id("run", F.col("run_id"), F.col("hypothesis_index")))
    hypotheses = rows.selectExpr(
        "run_id", "hypothesis_index", "hyp_key", "h.cause AS cause", "h.failure_class AS failure_class",
        "h.confidence AS confidence")
    citations = rows.selectExpr("hyp_key", "posexplode(h.evidence_ids) AS (pos, evidence_id)")
    return hypotheses, citations


# --- registry ---------------------------------------------------------------------------------


def evidence_registry(items: DataFrame, chunk_sources: DataFrame, flagged: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Evidence items with their source tag and flags.

    ``items``: evidence_id, kind, summary, t_s, passed. ``chunk_sources``: evidence_id,
    source_type, stale. ``flagged``: evidence_id with an injection hit. All carry the columns of ``scope`` (the log or
    run an id belongs to), which are part of every key.
    """
    key = [*scope, "evidence_id"]
    source = (
        "CASE WHEN kind IN ('metric', 'event', 'window') THEN 'telemetry' "
        "WHEN kind = 'chunk' THEN concat('doc:', coalesce(source_type, 'unknown')) ELSE kind END"
    )
    marks = flagged.select(*key).distinct().withColumn("hit", F.lit(True))
    return items.join(chunk_sources.select(*key, "source_type", "stale"), key, "left").join(marks, key, "left").selectExpr(
        *key, "kind", f"{source} AS source", "summary", "t_s", "passed",
        "kind = 'chunk' AND coalesce(stale, false) AS stale", "coalesce(hit, false) AS injection_flagged")


def duplicate_ids(registry: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Ids that occur more than once in their scope; a registry with any is invalid."""
    return registry.groupBy(*scope, "evidence_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def resolve_citations(citations: DataFrame, registry: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Cited ids, once per hypothesis at their first position, with the artifact or without.

    With ``scope`` an id resolves only to an artifact of the citing hypothesis' own scope.
    Few ids are cited twice, so a task holds all it gets: citations are dealt by hypothesis and id into parts of PART_ROWS on
    average, and more of them are more parts, not larger ones.
    """
    key = ["hyp_key", *scope, "evidence_id"]
    dealt = citations.repartition(-(-citations.count() // PART_ROWS) or 1, *key)
    cited = dealt.groupBy(*key).agg(F.min("pos").alias("pos"))
    known = registry.select(*scope, "evidence_id", "kind", "source", "t_s", "passed", "stale", "injection_flagged")
    return cited.join(known, [*scope, "evidence_id"], "left").withColumn("resolved", F.col("source").isNotNull())


def unknown_ids_in_text(
    texts_: DataFrame, registry: DataFrame, pattern: str = v.OBSERVATION_ID_PATTERN, scope: tuple[str, ...] = ()
) -> DataFrame:
    """Id-looking tokens of ``key, text`` that the registry does not hold (in the scope of the text)."""
    key = [*scope, "evidence_id"]
    tokens = texts_.selectExpr("key", *scope, f"explode(regexp_extract_all(text, {text(pattern)}, 0)) AS evidence_id").distinct()
    return tokens.join(registry.select(*key), key, "left_anti")


def assert_traceable(texts_: DataFrame, registry: DataFrame, own_ids: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Tokens that neither resolve nor are the report's own ids. Any row refuses the report."""
    unknown = unknown_ids_in_text(texts_, registry, v.REPORT_ID_PATTERN, scope)
    return unknown.join(own_ids.select("key", "evidence_id"), ["key", "evidence_id"], "left_anti")


def unresolved_ids(hypotheses: DataFrame, citations: DataFrame, registry: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Per run: cited ids that were never offered (to the citing scope)."""
    key = [*scope, "evidence_id"]
    cited = citations.join(hypotheses.select("hyp_key", "run_id"), "hyp_key").select("run_id", *key).distinct()
    return cited.join(registry.select(*key), key, "left_anti").select("run_id", "evidence_id")


# --- hypotheses ---------------------------------------------------------------------------------


def citation_profile(resolved: DataFrame) -> DataFrame:
    """Flags per hypothesis. First per source, then per hypothesis: the second step sees at most
    one row per evidence source."""
    per_source = resolved.groupBy("hyp_key", "source").agg(
        F.count(F.lit(1)).alias("cited"), F.min("pos").alias("pos"),
        F.count_if("resolved").alias("resolved"),
        F.count_if(F.col("t_s").isNotNull()).alias("timed"),
        F.count_if(F.coalesce("stale", F.lit(False))).alias("stale"),
        F.count_if(F.coalesce("injection_flagged", F.lit(False))).alias("flagged"),
        F.count_if(F.col("kind") == "metric").alias("metrics"),
        F.count_if((F.col("kind") == "metric") & F.coalesce("passed", F.lit(False))).alias("passing"),
    )
    counts = ["cited", "resolved", "timed", "stale", "flagged", "metrics", "passing"]
    sources = (
        f"transform(array_sort(collect_list(CASE WHEN source NOT IN ({texts(NOT_A_SOURCE)}) THEN "
        "named_struct('pos', pos, 'source', source) END)), s -> s.source)"
    )
    return per_source.groupBy("hyp_key").agg(
        *[F.sum(c).alias(c) for c in counts], F.expr(f"{sources} AS sources"))


def verify_hypotheses(hypotheses: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every hypothesis with its verdict: stripped with a reason, or kept with an adjusted score."""
    zero = ["cited", "resolved", "timed", "stale", "flagged", "metrics", "passing"]
    judged = hypotheses.join(citation_profile(resolved), "hyp_key", "left").fillna(0, subset=zero)
    single = "size(coalesce(sources, array())) <= 1"
    capped = f"IF({single}, least(confidence, {v.SINGLE_SOURCE_CAP}D), confidence)"
    less_stale = f"{capped} - IF(stale > 0, {v.STALE_PENALTY}D, 0D)"
    less_flagged = f"{less_stale} - IF(flagged > 0, {v.INJECTION_PENALTY}D, 0D)"
    weak = "(metrics > 0 AND passing = metrics)"
    score = f"{less_flagged} - IF({weak}, {v.PASSING_ONLY_PENALTY}D, 0D)"
    notes = ", ".join([
        f"IF({single}, 'single evidence source', NULL)",
        "IF(cited > resolved, concat(cited - resolved, ' cited ID(s) did not resolve and were removed'), NULL)",
        "IF(stale > 0, 'cites a stale document', NULL)",
        "IF(flagged > 0, 'cites a document that contained instruction-like text', NULL)",
        f"IF({weak}, 'cited metrics all pass; weak causal support', NULL)",
    ])
    return judged.selectExpr(
        "*",
        "CASE WHEN cited = 0 THEN 'no evidence cited' "
        "WHEN resolved = 0 THEN 'none of the cited evidence IDs resolve' "
        "WHEN timed = 0 THEN 'no timestamped evidence for a root cause' END AS reason",
        f"{single} AS single_source", f"{weak} AS passing_only",
        f"greatest(0D, least(1D, round({score}, 4))) AS score", f"concat_ws('; ', {notes}) AS note_text",
    ).selectExpr(
        "run_id", "hypothesis_index", "hyp_key", "cause", "failure_class", "confidence",
        "cited", "resolved", "stale", "flagged", "single_source", "passing_only", "reason",
        "coalesce(sources, CAST(array() AS ARRAY<STRING>)) AS sources",
        "CASE WHEN reason IS NOT NULL THEN 'unsupported' WHEN cited > resolved THEN 'partial' ELSE 'supported' END AS status",
        "IF(reason IS NULL, score, NULL) AS adjusted",
        "IF(reason IS NULL, note_text, NULL) AS notes",
    ).withColumn("label", F.when(F.col("adjusted").isNotNull(), cf.label_of(cf.band_level(F.col("adjusted")))))


def kept(verified: DataFrame) -> DataFrame:
    return verified.filter("reason IS NULL")


def rank_hypotheses(verified: DataFrame) -> DataFrame:
    """Kept hypotheses with ``rank`` by (highest adjusted, cause) within the run.

    Many scores are equal (capped ones are), so the ranges run over score, cause and index together.
    """
    order = [F.desc("adjusted"), F.col("cause"), F.col("hypothesis_index")]
    return ranked_by_range(kept(verified), ["run_id"], order, "rank").withColumn("rank", F.col("rank") + 1)


def cited_evidence_ids(ranked_hypotheses: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved ids of the kept hypotheses, each once per run, where it is first cited.

    Reading order is ``(rank, pos)``.
    """
    found = resolved.filter("resolved").join(ranked_hypotheses.select("hyp_key", "run_id", "rank"), "hyp_key")
    first = found.groupBy("run_id", "evidence_id").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return first.select("run_id", "evidence_id", F.col("at.rank").alias("rank"), F.col("at.pos").alias("pos"))


# --- audit log -----------------------------------------------------------------------------------


def hypothesis_rules(verified: DataFrame, resolved: DataFrame) -> DataFrame:
    """``run_id, hypothesis_index, rule, effect, detail``; rules about ids have a row per id."""
    whole = [
        ("cited = 0", "evidence_required", "stripped", "'hypothesis cites no evidence'"),
        ("reason = 'no timestamped evidence for a root cause'", "timestamped_evidence_required", "stripped",
         "'only untimestamped evidence (documents/metadata) cited'"),
        (f"reason IS NULL AND single_source AND confidence > {v.SINGLE_SOURCE_CAP}D", "single_source",
         f"confidence capped at {v.SINGLE_SOURCE_CAP}",
         "concat('sources: ', coalesce(nullif(array_join(sources, ', '), ''), 'none'))"),
        ("reason IS NULL AND passing_only", "passing_metrics_only", f"confidence -{v.PASSING_ONLY_PENALTY}",
         "'all cited metrics pass their thresholds'"),
    ]
    items = ", ".join(
        f"CASE WHEN {cond} THEN named_struct('rule', '{rule}', 'effect', '{effect}', 'detail', {detail}) END"
        for cond, rule, effect, detail in whole)
    scalar = verified.selectExpr("run_id", "hypothesis_index", f"inline(array_compact(array({items})))")
    per_id = [
        ("NOT resolved", "unresolvable_ids", "ids dropped"),
        ("reason IS NULL AND stale", "stale_document", f"confidence -{v.STALE_PENALTY}"),
        ("reason IS NULL AND injection_flagged", "injection_flagged_source", f"confidence -{v.INJECTION_PENALTY}"),
    ]
    hits = ", ".join(
        f"CASE WHEN {cond} THEN named_struct('rule', '{rule}', 'effect', '{effect}', 'detail', evidence_id) END"
        for cond, rule, effect in per_id)
    touched = resolved.filter("NOT resolved OR stale OR injection_flagged").join(
        verified.select("hyp_key", "run_id", "hypothesis_index", "reason"), "hyp_key")
    return scalar.unionByName(
        touched.selectExpr("run_id", "hypothesis_index", f"inline(array_compact(array({hits})))"))


# --- runs ------------------------------------------------------------------------------------------


def run_profile(verified: DataFrame) -> DataFrame:
    """Counts, top hypothesis and competing classes per run; partial-aggregates before shuffling."""
    strong = f"adjusted >= {v.COMPETING_THRESHOLD}D"
    top = ("min(CASE WHEN reason IS NULL THEN named_struct('n', -adjusted, 'cause', cause, 'i', hypothesis_index, "
           "'failure_class', failure_class, 'label', label, 'single', single_source) END)")
    offender = text("(?iU)" + v.REAL_WORLD_PATTERN)
    first_offender = (f"min(CASE WHEN reason IS NULL AND cause rlike {offender} THEN "
                      "named_struct('n', -adjusted, 'cause', cause) END)")
    return verified.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("hypotheses"), F.expr("count_if(reason IS NULL) AS kept"),
        F.expr("count_if(reason IS NOT NULL) AS stripped"),
        F.sum("cited").alias("cited_total"), F.sum("resolved").alias("cited_resolved"),
        F.expr(f"{top} AS top"), F.expr(f"{first_offender} AS offender"),
        F.expr(f"array_sort(collect_set(CASE WHEN {strong} THEN failure_class END)) AS classes"),
        F.expr("count_if(reason IS NULL AND flagged > 0) AS flagged_hypotheses"),
    )


def missing_critical(column: str = "missing") -> str:
    return (f"array_sort(filter(transform(coalesce({column}, array()), m -> substring_index(m, ':', 1)), "
            f"m -> m IN ({texts(v.CRITICAL_METRICS)})))")


def run_verdicts(runs: DataFrame, verified: DataFrame) -> DataFrame:
    """Report-level confidence, review flag, rates and limitations per run.

    ``runs``: run_id, quality_id, quality_verdict, warned_gates, data_origin, missing ARRAY, observations ARRAY,
    excluded_by_access.
    """
    wording = text("(?iU)" + v.REAL_WORLD_PATTERN)
    empty = ["hypotheses", "kept", "stripped", "cited_total", "cited_resolved", "flagged_hypotheses"]
    joined = runs.join(run_profile(verified), "run_id", "left").fillna(0, subset=empty).withColumn(
        "critical_missing", F.expr(missing_critical())
    ).withColumn("offender_text", F.expr(
        f"coalesce(offender.cause, try_element_at(filter(observations, o -> o rlike {wording}), 1))"))
    band = "CASE WHEN -top.n >= 0.7D THEN 3 WHEN -top.n >= 0.4D THEN 2 ELSE 1 END"
    ceiling = "IF(top.single OR quality_verdict = 'degraded', 2, 3)"
    base = (f"CASE WHEN quality_verdict = 'blocked' THEN 0 WHEN kept = 0 THEN 1 ELSE least({band}, {ceiling}) END")
    after_missing = f"IF(size(critical_missing) > 0, least({base}, 1), {base})"
    level = f"IF(flagged_hypotheses > 0, least({after_missing}, 2), {after_missing})"
    limitations = ", ".join([
        "IF(quality_verdict = 'degraded' AND kept > 0, concat('Data quality degraded (', warned_gates, "
        "'); confidence capped at Medium.'), NULL)",
        "IF(size(critical_missing) > 0 AND quality_verdict <> 'blocked', concat('Critical metric(s) unavailable: ', "
        "array_join(critical_missing, ', '), '.'), NULL)",
        f"IF(data_origin = 'synthetic', {text(v.SYNTHETIC_LIMITATION)}, NULL)",
        "IF(excluded_by_access > 0, concat(excluded_by_access, ' document chunk(s) were withheld by access control "
        "and not consulted.'), NULL)",
        "IF(stripped > 0, concat(stripped, ' agent hypothesis(es) removed as unsupported.'), NULL)",
    ])
    competing = "size(coalesce(classes, array())) > 1"
    worded = "(data_origin = 'synthetic' AND offender_text IS NOT NULL)"
    return joined.withColumn("verification_id", stable_id("verification", F.col("run_id"))).selectExpr(
        "run_id", "verification_id",
        f"element_at(array({texts(v.CONFIDENCE_ORDER)}), ({level}) + 1) AS report_confidence",
        f"({competing} OR flagged_hypotheses > 0 OR {worded}) AS human_review_required",
        f"{competing} AS competing", "flagged_hypotheses > 0 AS cites_flagged", f"{worded} AS real_world_wording",
        "array_join(classes, ', ') AS classes", "offender_text AS offender", "quality_id",
        "hypotheses", "kept", "stripped", "cited_total", "cited_resolved",
        "IF(cited_total > 0, cited_resolved / cited_total, 1D) AS evidence_support_rate",
        "IF(hypotheses > 0, stripped / hypotheses, 0D) AS unsupported_claim_rate",
        f"array_compact(array({limitations})) AS limitations",
        "array_join(critical_missing, ', ') AS critical_missing", "quality_verdict", "warned_gates",
        "top.cause AS top_cause", "top.failure_class AS top_class", "top.label AS top_label",
    )


def offending_texts(runs: DataFrame, verified: DataFrame) -> DataFrame:
    """``run_id, wording``: every kept cause and observation of a synthetic run that speaks of the real world, whole and once."""
    wording = text("(?iU)" + v.REAL_WORLD_PATTERN)
    synthetic = runs.where("data_origin = 'synthetic'")
    causes = kept(verified).select("run_id", F.col("cause").alias("wording")).join(synthetic.select("run_id"), "run_id", "left_semi")
    return causes.unionByName(synthetic.selectExpr("run_id", "explode(observations) AS wording")).where(f"wording rlike {wording}").distinct()


def review_reasons(verdicts: DataFrame, verified: DataFrame, resolved: DataFrame, offenders: DataFrame) -> DataFrame:
    """Why a person must look: ``run_id, reason, detail``; one row per flagged document and per offending text."""
    of_run = verdicts.where("competing").selectExpr(
        "run_id", "'competing high-confidence hypotheses with different failure classes' AS reason", "classes AS detail").unionByName(
        offenders.selectExpr("run_id", "'real-world language used on synthetic evidence' AS reason", "wording AS detail"))
    flagged = resolved.filter("injection_flagged").join(
        kept(verified).select("hyp_key", "run_id"), "hyp_key"
    ).select("run_id", "evidence_id").distinct()
    return of_run.unionByName(flagged.select(
        "run_id", F.lit("cited documents contained instruction-like text").alias("reason"),
        F.col("evidence_id").alias("detail")))


def run_rules(verdicts: DataFrame, offenders: DataFrame) -> DataFrame:
    """Report-level audit rows; rules about wording have a row per text."""
    items = [
        ("quality_verdict = 'blocked'", "quality_blocked", "BLOCKED", "quality_id"),
        ("quality_verdict <> 'blocked' AND kept = 0", "no_supported_hypothesis", "LOW",
         "concat(stripped, ' hypothesis(es) stripped')"),
        ("quality_verdict = 'degraded' AND kept > 0", "quality_degraded", "cap MEDIUM", "warned_gates"),
        ("critical_missing <> '' AND quality_verdict <> 'blocked'", "critical_metric_missing", "cap LOW",
         "critical_missing"),
        ("competing", "contradictory_evidence", "human review", "classes"),
    ]
    rows = ", ".join(
        f"CASE WHEN {cond} THEN named_struct('rule', '{rule}', 'effect', '{effect}', 'detail', {detail}) END"
        for cond, rule, effect, detail in items)
    of_run = verdicts.selectExpr("run_id", "CAST(NULL AS BIGINT) AS hypothesis_index", f"inline(array_compact(array({rows})))")
    return of_run.unionByName(offenders.selectExpr(
        "run_id", "CAST(NULL AS BIGINT) AS hypothesis_index", "'synthetic_no_real_world_claims' AS rule", "'human review' AS effect",
        "wording AS detail"))


def id_rules(ids: DataFrame, rule: str, effect: str) -> DataFrame:
    """Audit rows for ids found at run level, such as ids still unresolved after a repair round
    (``agent_unresolved_after_repair``) or unknown ids in observations (``observation_unknown_ids``)."""
    return ids.select(
        "run_id", F.lit(None).cast("bigint").alias("hypothesis_index"), F.lit(rule).alias("rule"),
        F.lit(effect).alias("effect"), F.col("evidence_id").alias("detail"))


def missing_evidence_union(agent: DataFrame, pipeline: DataFrame) -> DataFrame:
    """Agent's list, then the pipeline's, each item once per run: ``run_id, item, part, pos``."""
    both = agent.select("run_id", "item", F.lit(0).alias("part"), F.col("pos").cast("bigint").alias("pos")).unionByName(
        pipeline.select("run_id", "item", F.lit(1).alias("part"), F.col("pos").cast("bigint").alias("pos")))
    first = both.groupBy("run_id", "item").agg(F.min(F.struct("part", "pos")).alias("at"))
    return first.select("run_id", "item", "at.part", "at.pos")


def answer_contract(verdicts: DataFrame) -> DataFrame:
    """The answer of a run; its evidence ids and unsupported claims are tables of their own."""
    return verdicts.selectExpr(
        "run_id", "verification_id",
        "CASE WHEN kept > 0 THEN concat(top_cause, ' (failure class: ', top_class, '; confidence ', top_label, ')') "
        "ELSE 'No hypothesis survived evidence verification.' END AS answer",
        "report_confidence AS confidence", "human_review_required", "evidence_support_rate",
        "stripped AS unsupported_claims")


def unsupported_claims(verified: DataFrame) -> DataFrame:
    return verified.filter("reason IS NOT NULL").selectExpr(
        "run_id", "hypothesis_index", "concat(cause, ' (', reason, ')') AS claim")
