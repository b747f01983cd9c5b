"""Evidence verification and confidence rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge import vocab as v
from fleetgauge.functions import confidence as cf
from fleetgauge.functions import text as tx
from fleetgauge.operators import verification as vf
from fleetgauge.plans import fixtures as fx
from fleetgauge.plans import verification_views as vv  # noqa: F401  (adds the views)
from fleetgauge.plans.registry import register, rounded
from fleetgauge.session import stored


def _resolved(spark, sf_dir):
    return vf.resolve_citations(fx.citations(spark, sf_dir), fx.evidence(spark, sf_dir))


def verified(spark, sf_dir):
    return vf.verify_hypotheses(fx.hypotheses(spark, sf_dir), _resolved(spark, sf_dir))


def verdicts(spark, sf_dir):
    return vf.run_verdicts(fx.runs(spark, sf_dir), verified(spark, sf_dir))


@register("confidence_band", f"""
SELECT hyp_key, {vv._BAND.format('confidence')} AS band,
  CASE WHEN confidence >= 4e-1 THEN 'medium' ELSE 'low' END AS capped FROM v_hyp""")
def confidence_band(spark, sf_dir):
    level = cf.band_level(F.col("confidence"))
    return fx.hypotheses(spark, sf_dir).select(
        "hyp_key", cf.label_of(level).alias("band"),
        cf.label_of(cf.capped(level, "medium", F.lit(True))).alias("capped"))


@register("real_world_language", f"""
SELECT hyp_key, regexp_matches(cause, '(?i){vv._REAL}') AS flagged FROM v_hyp""")
def real_world_language(spark, sf_dir):
    return fx.hypotheses(spark, sf_dir).select("hyp_key", tx.real_world_language(F.col("cause")).alias("flagged"))


@register("parse_agent_outputs", """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderkey % 7 <> 0 AND (o_orderkey % 10 = 0 OR o_orderkey % 13 <> 0)
    AND o_orderkey % 11 <> 0 AND o_orderkey % 23 <> 0 AS accepted,
  CASE WHEN o_orderkey % 7 = 0 OR (o_orderkey % 10 <> 0 AND o_orderkey % 13 = 0) THEN 'model output is not JSON of the agreed shape'
       WHEN o_orderkey % 11 = 0 OR o_orderkey % 23 = 0 THEN 'model output does not match the schema' END AS rejected
FROM orders""")
def parse_agent_outputs(spark, sf_dir):
    parsed = vf.parse_agent_outputs(fx.raw_outputs(spark, sf_dir))
    return parsed.selectExpr("run_id", "rejected IS NULL AS accepted", "rejected")


@register("parsed_hypotheses", """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'cause ' || CAST(o_orderkey AS VARCHAR) AS cause, 'control_issue' AS failure_class,
  5e-1 AS confidence, o_orderpriority AS evidence_id FROM orders
WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 10 = 0 OR o_orderkey % 13 <> 0) AND o_orderkey % 11 <> 0 AND o_orderkey % 23 <> 0""")
def parsed_hypotheses(spark, sf_dir):
    hyps, cites = vf.explode_hypotheses(vf.accepted(vf.parse_agent_outputs(fx.raw_outputs(spark, sf_dir))))
    return hyps.join(cites, "hyp_key").select("run_id", "cause", "failure_class", "confidence", "evidence_id")


@register("evidence_registry", """
SELECT evidence_id, kind, CASE WHEN kind = 'chunk' AND CAST(right(evidence_id, 12) AS BIGINT) % 4 = 1 THEN 'doc:unknown' ELSE source END AS source,
  t_s, passed, stale AND CAST(right(evidence_id, 12) AS BIGINT) % 4 <> 1 AS stale, injection_flagged FROM v_evidence""")
def evidence_registry(spark, sf_dir):
    """Items, retrieval metadata (missing for every fourth id) and injection hits joined again."""
    ev = fx.evidence(spark, sf_dir)
    items = ev.select("evidence_id", "kind", "summary", "t_s", "passed")
    sources = ev.filter("kind = 'chunk' and cast(right(evidence_id, 12) as bigint) % 4 <> 1").selectExpr(
        "evidence_id", "substring(source, 5) as source_type", "stale")
    flagged = ev.filter("injection_flagged").select("evidence_id")
    return vf.evidence_registry(items, sources, flagged).drop("summary")


@register("duplicate_evidence_ids", """
SELECT evidence_id, count(*) AS n FROM v_cite GROUP BY 1 HAVING count(*) > 1""")
def duplicate_evidence_ids(spark, sf_dir):
    return vf.duplicate_ids(fx.citations(spark, sf_dir))


@register("resolve_citations", """
SELECT hyp_key, evidence_id, resolved, source, t_s, row_number() OVER (PARTITION BY hyp_key ORDER BY pos) AS place FROM v_resolved""")
def resolve_citations(spark, sf_dir):
    from fleetgauge.operators.segments import ranked

    places = ranked(_resolved(spark, sf_dir), ["hyp_key"], [F.col("pos")], F.shiftright("pos", 44), "place")
    return places.select("hyp_key", "evidence_id", "resolved", "source", "t_s", (F.col("place") + 1).alias("place"))


@register("unknown_ids_in_text", """
SELECT DISTINCT c.hyp_key AS key, c.evidence_id FROM v_cite c LEFT JOIN v_evidence e ON c.evidence_id = e.evidence_id WHERE e.evidence_id IS NULL
UNION SELECT h.hyp_key, h.run_id FROM v_hyp h JOIN v_cite c ON h.hyp_key = c.hyp_key""")
def unknown_ids_in_text(spark, sf_dir):
    return vf.unknown_ids_in_text(fx.observations(spark, sf_dir), fx.evidence(spark, sf_dir)).select("key", "evidence_id")


@register("assert_traceable", """
SELECT DISTINCT c.hyp_key AS key, c.evidence_id FROM v_cite c LEFT JOIN v_evidence e ON c.evidence_id = e.evidence_id WHERE e.evidence_id IS NULL""")
def assert_traceable(spark, sf_dir):
    texts = fx.observations(spark, sf_dir)
    own = texts.select("key", F.col("run_id").alias("evidence_id")).distinct()
    return vf.assert_traceable(texts, fx.evidence(spark, sf_dir), own).select("key", "evidence_id")


@register("unresolved_ids", """
SELECT DISTINCT h.run_id, c.evidence_id FROM v_cite c JOIN v_hyp h ON c.hyp_key = h.hyp_key LEFT JOIN v_evidence e ON c.evidence_id = e.evidence_id
WHERE e.evidence_id IS NULL""")
def unresolved_ids(spark, sf_dir):
    return vf.unresolved_ids(
        fx.hypotheses(spark, sf_dir), fx.citations(spark, sf_dir), fx.evidence(spark, sf_dir))


@register("untimestamped_hypotheses", """
SELECT run_id, hypothesis_index FROM v_hyp h LEFT JOIN v_hprof p ON h.hyp_key = p.hyp_key WHERE coalesce(timed, 0) = 0""")
def untimestamped_hypotheses(spark, sf_dir):
    return verified(spark, sf_dir).filter("reason IS NOT NULL").select("run_id", "hypothesis_index")


@register("strip_unsupported", "SELECT run_id, hypothesis_index, cause, reason FROM v_verified WHERE reason IS NOT NULL")
def strip_unsupported(spark, sf_dir):
    return verified(spark, sf_dir).filter("reason IS NOT NULL").select("run_id", "hypothesis_index", "cause", "reason")


@register("adjust_confidence", """
SELECT run_id, hypothesis_index, confidence AS agent_confidence, adjusted, label FROM v_kept""")
def adjust_confidence(spark, sf_dir):
    return vf.kept(verified(spark, sf_dir)).select(
        "run_id", "hypothesis_index", F.col("confidence").alias("agent_confidence"), "adjusted", "label")


@register("claim_status", "SELECT run_id, hypothesis_index, status, sources, resolved, cited - resolved AS dropped FROM v_kept")
def claim_status(spark, sf_dir):
    return vf.kept(verified(spark, sf_dir)).selectExpr(
        "run_id", "hypothesis_index", "status", "array_join(sources, ', ') AS sources", "resolved",
        "cited - resolved AS dropped")


@register("hypothesis_notes", """
SELECT run_id, hypothesis_index, concat_ws('; ', CASE WHEN single_source THEN 'single evidence source' END,
  CASE WHEN cited > resolved THEN CAST(cited - resolved AS VARCHAR) || ' cited ID(s) did not resolve and were removed' END,
  CASE WHEN stale > 0 THEN 'cites a stale document' END, CASE WHEN flagged > 0 THEN 'cites a document that contained instruction-like text' END,
  CASE WHEN passing_only THEN 'cited metrics all pass; weak causal support' END) AS notes FROM v_kept""")
def hypothesis_notes(spark, sf_dir):
    return vf.kept(verified(spark, sf_dir)).select("run_id", "hypothesis_index", "notes")


@register("rank_hypotheses", "SELECT run_id, rank, hyp_key, cause, adjusted FROM v_kept")
def rank_hypotheses(spark, sf_dir):
    return vf.rank_hypotheses(verified(spark, sf_dir)).select("run_id", "rank", "hyp_key", "cause", "adjusted")


@register("cited_evidence_ids", """
SELECT run_id, evidence_id, min(rank) AS rank FROM v_kept k JOIN v_resolved r ON k.hyp_key = r.hyp_key WHERE r.resolved GROUP BY 1, 2""")
def cited_evidence_ids(spark, sf_dir):
    ranked_hyps = vf.rank_hypotheses(verified(spark, sf_dir))
    return vf.cited_evidence_ids(ranked_hyps, _resolved(spark, sf_dir)).select("run_id", "evidence_id", "rank")


_RULES_SQL = """
SELECT run_id, hypothesis_index, 'evidence_required' AS rule, 'stripped' AS effect, 'hypothesis cites no evidence' AS detail FROM v_verified WHERE cited = 0
UNION ALL SELECT run_id, hypothesis_index, 'timestamped_evidence_required', 'stripped', 'only untimestamped evidence (documents/metadata) cited'
  FROM v_verified WHERE reason = 'no timestamped evidence for a root cause'
UNION ALL SELECT run_id, hypothesis_index, 'single_source', 'confidence capped at 0.6', 'sources: ' || CASE WHEN sources = '' THEN 'none' ELSE sources END
  FROM v_kept WHERE single_source AND confidence > 6e-1
UNION ALL SELECT run_id, hypothesis_index, 'passing_metrics_only', 'confidence -0.15', 'all cited metrics pass their thresholds' FROM v_kept WHERE passing_only
UNION ALL SELECT run_id, hypothesis_index, 'unresolvable_ids', 'ids dropped', evidence_id FROM v_verified h JOIN v_resolved r ON h.hyp_key = r.hyp_key WHERE NOT r.resolved
UNION ALL SELECT run_id, hypothesis_index, 'stale_document', 'confidence -0.1', evidence_id FROM v_kept h JOIN v_resolved r ON h.hyp_key = r.hyp_key WHERE r.stale
UNION ALL SELECT run_id, hypothesis_index, 'injection_flagged_source', 'confidence -0.2', evidence_id FROM v_kept h JOIN v_resolved r ON h.hyp_key = r.hyp_key WHERE r.injection_flagged
UNION ALL SELECT run_id, NULL, 'quality_blocked', 'BLOCKED', quality_id FROM v_verdicts WHERE quality_verdict = 'blocked'
UNION ALL SELECT run_id, NULL, 'no_supported_hypothesis', 'LOW', CAST(stripped AS VARCHAR) || ' hypothesis(es) stripped' FROM v_verdicts WHERE quality_verdict <> 'blocked' AND kept = 0
UNION ALL SELECT run_id, NULL, 'quality_degraded', 'cap MEDIUM', 'scenario_completeness' FROM v_verdicts WHERE quality_verdict = 'degraded' AND kept > 0
UNION ALL SELECT run_id, NULL, 'critical_metric_missing', 'cap LOW', 'braking_latency_s' FROM v_verdicts WHERE quality_verdict <> 'blocked' AND missing IS NOT NULL
UNION ALL SELECT run_id, NULL, 'contradictory_evidence', 'human review', classes FROM v_verdicts WHERE competing
UNION ALL SELECT run_id, NULL, 'synthetic_no_real_world_claims', 'human review', wording FROM v_offenders
UNION ALL SELECT run_id, NULL, 'agent_unresolved_after_repair', 'recorded', evidence_id FROM (
  SELECT DISTINCT h.run_id, r.evidence_id FROM v_hyp h JOIN v_resolved r ON h.hyp_key = r.hyp_key WHERE NOT r.resolved) u
UNION ALL SELECT run_id, NULL, 'observation_unknown_ids', 'observation flagged', evidence_id FROM (
  SELECT DISTINCT h.run_id, r.evidence_id FROM v_hyp h JOIN v_resolved r ON h.hyp_key = r.hyp_key WHERE NOT r.resolved
  UNION SELECT h.run_id, h.run_id FROM v_hyp h JOIN v_cite c ON h.hyp_key = c.hyp_key) o"""


def _unknown_observed(spark, sf_dir):
    texts = fx.observations(spark, sf_dir).select(F.col("run_id").alias("key"), "text")
    return vf.unknown_ids_in_text(texts, fx.evidence(spark, sf_dir)).withColumnRenamed("key", "run_id")


@register("applied_rules", _RULES_SQL)
def applied_rules(spark, sf_dir):
    # each is read by several rules; written once, their shuffles don't pile up on disk
    resolved = stored(_resolved(spark, sf_dir), "resolved")
    hyps = stored(vf.verify_hypotheses(fx.hypotheses(spark, sf_dir), resolved), "verified")
    unresolved = vf.unresolved_ids(
        fx.hypotheses(spark, sf_dir), fx.citations(spark, sf_dir), fx.evidence(spark, sf_dir))
    return (
        vf.hypothesis_rules(hyps, resolved)
        .unionByName(vf.run_rules(vf.run_verdicts(fx.runs(spark, sf_dir), hyps), vf.offending_texts(fx.runs(spark, sf_dir), hyps)))
        .unionByName(vf.id_rules(unresolved, "agent_unresolved_after_repair", "recorded"))
        .unionByName(vf.id_rules(_unknown_observed(spark, sf_dir), "observation_unknown_ids", "observation flagged")))


@register("run_confidence", "SELECT run_id, report_confidence, kept, stripped FROM v_verdicts")
def run_confidence(spark, sf_dir):
    return verdicts(spark, sf_dir).select("run_id", "report_confidence", "kept", "stripped")


@register("human_review", """
SELECT run_id, 'competing high-confidence hypotheses with different failure classes' AS reason, classes AS detail FROM v_verdicts WHERE competing
UNION ALL SELECT run_id, 'real-world language used on synthetic evidence', wording FROM v_offenders
UNION ALL SELECT * FROM (SELECT DISTINCT run_id, 'cited documents contained instruction-like text', evidence_id
  FROM v_kept k JOIN v_resolved r ON k.hyp_key = r.hyp_key WHERE r.injection_flagged) f""")
def human_review(spark, sf_dir):
    hyps = verified(spark, sf_dir)
    return vf.review_reasons(verdicts(spark, sf_dir), hyps, _resolved(spark, sf_dir), vf.offending_texts(fx.runs(spark, sf_dir), hyps))


@register("support_rates", """
SELECT run_id, cited_total, cited_resolved, round(support, 6) AS evidence_support_rate, round(unsupported, 6) AS unsupported_claim_rate FROM v_verdicts""")
def support_rates(spark, sf_dir):
    return rounded(verdicts(spark, sf_dir).select(
        "run_id", "cited_total", "cited_resolved", "evidence_support_rate", "unsupported_claim_rate"),
        "evidence_support_rate", "unsupported_claim_rate")


@register("limitations", f"""
SELECT run_id, concat_ws(' | ',
  CASE WHEN quality_verdict = 'degraded' AND kept > 0 THEN 'Data quality degraded (scenario_completeness); confidence capped at Medium.' END,
  CASE WHEN missing IS NOT NULL AND quality_verdict <> 'blocked' THEN 'Critical metric(s) unavailable: braking_latency_s.' END,
  CASE WHEN data_origin = 'synthetic' THEN '{v.SYNTHETIC_LIMITATION}' END,
  CASE WHEN excluded_by_access > 0 THEN CAST(excluded_by_access AS VARCHAR) || ' document chunk(s) were withheld by access control and not consulted.' END,
  CASE WHEN stripped > 0 THEN CAST(stripped AS VARCHAR) || ' agent hypothesis(es) removed as unsupported.' END) AS limitations FROM v_verdicts""")
def limitations(spark, sf_dir):
    return verdicts(spark, sf_dir).selectExpr("run_id", "array_join(limitations, ' | ') AS limitations")


@register("missing_evidence_union", """
SELECT run_id, item, row_number() OVER (PARTITION BY run_id ORDER BY part, pos) AS place FROM (
  SELECT run_id, item, min(part) AS part, arg_min(pos, part * 1e15 + pos) AS pos FROM (
    SELECT concat('run_', lpad(CAST(o_custkey AS VARCHAR(12)), 12, '0')) AS run_id, CASE WHEN o_orderkey % 50 = 0 THEN 'braking_latency_s: no brake command' ELSE 'need ' || o_orderpriority END AS item, 0 AS part, o_orderkey AS pos FROM orders
    UNION ALL SELECT run_id, missing, 1, 0 FROM v_runs WHERE missing IS NOT NULL) u GROUP BY 1, 2) x""")
def missing_evidence_union(spark, sf_dir):
    agent = fx.table(spark, sf_dir, "orders").selectExpr(
        "concat('run_', lpad(cast(o_custkey as string), 12, '0')) as run_id", "o_orderkey as pos",
        "case when o_orderkey % 50 = 0 then 'braking_latency_s: no brake command' "
        "else concat('need ', o_orderpriority) end as item")
    pipeline = fx.runs(spark, sf_dir).selectExpr("run_id", "posexplode(missing) as (pos, item)")
    union = vf.missing_evidence_union(agent, pipeline)
    from pyspark.sql import Window
    # at most one row per distinct item of a run is left here
    order = Window.partitionBy("run_id").orderBy("part", "pos")
    return union.select("run_id", "item", F.row_number().over(order).cast("bigint").alias("place"))


@register("answer_contract", """
SELECT run_id, verification_id, CASE WHEN kept > 0 THEN top_cause || ' (failure class: ' || top_class || '; confidence ' || top_label || ')'
  ELSE 'No hypothesis survived evidence verification.' END AS answer, report_confidence AS confidence, human_review_required,
  round(support, 6) AS evidence_support_rate, stripped AS unsupported_claims FROM v_verdicts""")
def answer_contract(spark, sf_dir):
    return rounded(vf.answer_contract(verdicts(spark, sf_dir)), "evidence_support_rate")


@register("unsupported_claims", "SELECT run_id, hypothesis_index, cause || ' (' || reason || ')' AS claim FROM v_verified WHERE reason IS NOT NULL")
def unsupported_claims(spark, sf_dir):
    return vf.unsupported_claims(verified(spark, sf_dir))
