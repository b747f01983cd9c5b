"""Scoring of pipelines and agent runs against locked expectations."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge import vocab as v
from fleetgauge.functions import confidence as cf
from fleetgauge.functions.sqltext import num, text
from fleetgauge.operators.segments import order_values
from fleetgauge.policies import ReleaseThresholds


# --- deterministic checks ------------------------------------------------------------------------


def check_blocked(cases: DataFrame, errors: DataFrame) -> DataFrame:
    """``cases``: case_id, expected_outcome, expected_quality; ``errors``: case_id, error.

    Rows for cases the gates refused, and for those they should have refused.
    """
    joined = cases.join(errors, "case_id", "left").filter("error IS NOT NULL OR expected_outcome = 'blocked'")
    return joined.selectExpr(
        "case_id", "IF(expected_outcome = 'blocked', 'quality_blocked', 'quality_verdict') AS name",
        "expected_outcome = 'blocked' AND error IS NOT NULL AS passed",
        "CASE WHEN expected_outcome <> 'blocked' THEN concat('expected ', expected_quality, ', gates blocked: ', error) "
        "ELSE coalesce(error, 'gates let the file through; expected BLOCKED') END AS detail")


def check_quality(cases: DataFrame, quality: DataFrame) -> DataFrame:
    return cases.join(quality.select(F.col("file_id").alias("case_id"), "verdict"), "case_id").selectExpr(
        "case_id", "'quality_verdict' AS name", "verdict = expected_quality AS passed",
        "concat('expected ', expected_quality, ', got ', verdict) AS detail")


def check_events(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Expected events must be there, forbidden ones must not."""
    wanted = cases.selectExpr(
        "case_id", "explode(concat(transform(expected_events, e -> struct(e AS kind, true AS want)), "
        "transform(forbidden_events, e -> struct(e AS kind, false AS want)))) AS x"
    ).select("case_id", F.col("x.kind").alias("event_type"), F.col("x.want").alias("want"))
    seen = events.select(F.col("file_id").alias("case_id"), "event_type").distinct().withColumn("seen", F.lit(True))
    return wanted.join(seen, ["case_id", "event_type"], "left").selectExpr(
        "case_id", "concat(IF(want, 'event_present:', 'event_absent:'), event_type) AS name",
        "want = coalesce(seen, false) AS passed",
        "CASE WHEN want THEN IF(coalesce(seen, false), 'present', 'missing') "
        "ELSE IF(coalesce(seen, false), 'present but forbidden', 'absent') END AS detail")


def check_metric_verdicts(cases: DataFrame, metrics: DataFrame) -> DataFrame:
    wanted = cases.selectExpr("case_id", "explode(expected_metric_verdicts) AS (metric, expected)")
    got = metrics.selectExpr("file_id AS case_id", "name AS metric", "passed", "missing_reason",
                             "coalesce(string(round(value, 6)), string(value_bool)) AS shown")
    return wanted.join(got.withColumn("found", F.lit(True)), ["case_id", "metric"], "left").selectExpr(
        "case_id", "concat('metric:', metric) AS name", "coalesce(passed = expected, false) AS passed",
        "CASE WHEN found IS NULL THEN 'missing' "
        "WHEN passed IS NULL THEN concat('no verdict (', coalesce(missing_reason, 'no threshold'), ')') "
        "ELSE concat('expected ', IF(expected, 'PASS', 'FAIL'), ', got ', IF(passed, 'PASS', 'FAIL'), "
        "' (value=', shown, ')') END AS detail")


def check_ground_truth(truth: DataFrame, metrics: DataFrame) -> DataFrame:
    """``truth``: case_id, collision, braking_latency_s. Metrics must agree within two samples."""
    wanted = ("max(CASE WHEN name = '{0}' THEN {1} END) AS {2}")
    got = metrics.groupBy(F.col("file_id").alias("case_id")).agg(
        F.expr(wanted.format(v.M_COLLISION, "value_bool", "got_collision")),
        F.expr(wanted.format(v.M_LATENCY, "value", "got_latency")))
    off = f"abs(got_latency - braking_latency_s) <= {num(v.GROUND_TRUTH_TOLERANCE_S)}"
    rows = (
        "array_compact(array(named_struct('name', 'ground_truth:collision', 'passed', "
        "coalesce(got_collision = collision, false), 'detail', concat('generator=', collision, ', metrics=', "
        "coalesce(string(got_collision), 'none'))), "
        "CASE WHEN braking_latency_s IS NOT NULL THEN named_struct('name', 'ground_truth:braking_latency_s', "
        f"'passed', coalesce({off}, false), 'detail', concat('generator=', format_string('%.3f', braking_latency_s), "
        "', metrics=', coalesce(string(got_latency), 'none'))) END))"
    )
    return truth.join(got, "case_id").selectExpr("case_id", f"inline({rows})")


# --- agent checks --------------------------------------------------------------------------------


def agent_profile(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case: top class, rank of the first class that the case accepts, and fault claims with a label."""
    accepts = cases.select(F.col("case_id").alias("run_id"), "acceptable_classes")
    return ranked.join(accepts, "run_id").groupBy(F.col("run_id").alias("case_id")).agg(
        F.expr("min_by(failure_class, rank) AS top_class"),
        F.expr("min(CASE WHEN array_contains(acceptable_classes, failure_class) THEN rank END) AS acceptable_rank"),
        F.expr("count_if(failure_class <> 'unknown' AND label IN ('medium', 'high')) AS false_faults"),
        F.count(F.lit(1)).alias("verified"))


def check_agent(cases: DataFrame, verdicts: DataFrame, ranked: DataFrame) -> DataFrame:
    """``cases``: case_id (= run id), expected_outcome, max_report_confidence, acceptable_classes ARRAY."""
    label = "array_join(array_sort(acceptable_classes), ', ')"
    joined = cases.join(
        verdicts.select(F.col("run_id").alias("case_id"), "report_confidence"), "case_id"
    ).join(agent_profile(ranked, cases), "case_id", "left")
    capped = joined.withColumn("_level", cf.level_of(F.col("report_confidence"))).withColumn(
        "_cap", cf.level_of(F.col("max_report_confidence")))
    rows = (
        "array_compact(array("
        "CASE WHEN expected_outcome = 'fault' THEN named_struct('name', 'top_hypothesis_class', 'passed', "
        "coalesce(array_contains(acceptable_classes, top_class), false), 'detail', IF(top_class IS NULL, 'no supported hypothesis survived "
        f"verification', concat('top=', top_class, ', acceptable=', {label}, ', first acceptable at rank ', "
        "coalesce(string(acceptable_rank), 'none')))) END, "
        "CASE WHEN expected_outcome = 'nominal' THEN named_struct('name', 'no_false_fault', 'passed', "
        "coalesce(false_faults, 0) = 0, 'detail', IF(coalesce(false_faults, 0) = 0, 'no fault hypothesis at or above "
        "medium', concat(false_faults, ' fault hypotheses on a nominal log'))) END, "
        "CASE WHEN _cap IS NOT NULL THEN named_struct('name', 'confidence_cap', 'passed', _level <= _cap, 'detail', "
        "concat('report ', report_confidence, ', cap ', max_report_confidence)) END))"
    )
    return capped.selectExpr("case_id", f"inline({rows})")


def case_status(cases: DataFrame, checks: DataFrame) -> DataFrame:
    """error > all checks pass > fail. ``cases``: case_id, error."""
    passed = checks.groupBy("case_id").agg(F.expr("bool_and(passed) AS all_passed"))
    return cases.join(passed, "case_id", "left").withColumn(
        "status", F.when(F.col("error").isNotNull(), "error")
        .when(F.coalesce("all_passed", F.lit(True)), "pass").otherwise("fail")).drop("all_passed")


# --- aggregates ------------------------------------------------------------------------------------


def nearest_rank_percentiles(df: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Element at the half-even rounded index ``q * (n - 1)`` of the sorted values; one row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.lit(1).alias("all"), value).agg(
        F.count(F.lit(1)).alias("n"))
    ranks = {out: f"greatest(0, least(total - 1, bround({num(q)} * (total - 1))))" for out, q in quantiles.items()}
    return order_values(counts, "all", value, "n", ranks).drop("all")


def eval_aggregates(results: DataFrame, checks: DataFrame) -> DataFrame:
    """One row. ``results``: case_id, expected_outcome, status, agent_ran, evidence_support_rate,
    unsupported_claim_rate, latency_s, prompt_tokens, completion_tokens, human_review_required."""
    named = checks.filter("name IN ('top_hypothesis_class', 'no_false_fault')").groupBy("case_id").agg(
        F.expr("bool_or(CASE WHEN name = 'top_hypothesis_class' THEN passed END) AS top1"),
        F.expr("bool_or(CASE WHEN name = 'no_false_fault' THEN passed END) AS clean"))
    joined = results.join(named, "case_id", "left")
    scored = "agent_ran"
    fault = f"{scored} AND expected_outcome = 'fault' AND top1 IS NOT NULL"
    nominal = f"{scored} AND expected_outcome = 'nominal' AND clean IS NOT NULL"
    measures = {
        "n_cases": "count(1)", "n_passed": "count_if(status = 'pass')", "n_failed": "count_if(status = 'fail')",
        "n_errors": "count_if(status = 'error')", "n_agent_cases": f"count_if({scored})",
        "n_fault_cases_scored": f"count_if({fault})", "n_nominal_cases_scored": f"count_if({nominal})",
        "top1_accuracy": f"try_divide(count_if({fault} AND top1), count_if({fault}))",
        "false_fault_rate": f"try_divide(count_if({nominal} AND NOT clean), count_if({nominal}))",
        "mean_evidence_support_rate": f"avg(CASE WHEN {scored} THEN evidence_support_rate END)",
        "max_unsupported_claim_rate": f"max(CASE WHEN {scored} THEN unsupported_claim_rate END)",
        "prompt_tokens": f"coalesce(sum(CASE WHEN {scored} THEN prompt_tokens END), 0)",
        "completion_tokens": f"coalesce(sum(CASE WHEN {scored} THEN completion_tokens END), 0)",
        "n_human_review_required": f"count_if({scored} AND human_review_required)",
    }
    one = joined.agg(*[F.expr(f"{sql} AS {name}") for name, sql in measures.items()])
    tails = nearest_rank_percentiles(
        results.filter(scored), "latency_s", {"latency_p50_s": 0.5, "latency_p95_s": 0.95})
    return one.join(F.broadcast(_at_least_one(tails)))  # one row each


def _at_least_one(df: DataFrame) -> DataFrame:
    """A one-row frame that stays one row (of nulls) when there is nothing to aggregate."""
    return df.agg(*[F.max(c).alias(c) for c in df.columns])


def release_gate(
    results: DataFrame, checks: DataFrame, aggregates: DataFrame, thresholds: ReleaseThresholds = ReleaseThresholds(),
    baseline_failures: DataFrame | None = None,
) -> DataFrame:
    """Failure rows ``scope, failure``; the release passes when there are none.

    ``results``: case_id, status, error. ``checks``: deterministic checks and those against the ground truth.
    ``baseline_failures``: rows of ``baseline_compare``; without a baseline nothing is compared.
    """
    limits = asdict(thresholds)
    errors = results.filter("status = 'error'").selectExpr("case_id AS scope", "concat('error: ', error) AS failure")
    failed = checks.filter("NOT passed").selectExpr("case_id AS scope", "concat(name, ': ', detail) AS failure")
    bars = [
        ("max_unsupported_claim_rate", "unsupported_claim_rate", limits["max_unsupported_claim_rate"], ">"),
        ("mean_evidence_support_rate", "evidence_support_rate", limits["min_evidence_support_rate"], "<"),
        ("top1_accuracy", "top1_accuracy", limits["min_top1_accuracy"], "<"),
        ("false_fault_rate", "false_fault_rate", limits["max_false_fault_rate"], ">"),
    ]
    rows = ", ".join(
        f"CASE WHEN {column} {op} {num(limit)} THEN concat('{shown} ', format_string('%.2f', {column}), ' {op} {limit:.2f}') END"
        for column, shown, limit, op in bars if limit is not None)
    over = aggregates.selectExpr("'aggregate' AS scope", f"explode(array_compact(array({rows}))) AS failure")
    out = errors.unionByName(failed).unionByName(over)
    return out if baseline_failures is None else out.unionByName(baseline_failures)


def baseline_regressions(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cases that passed in the baseline and do not pass now."""
    before = baseline.filter("status = 'pass'").select("case_id")
    return results.filter("status <> 'pass'").join(before, "case_id", "left_semi").selectExpr(
        "case_id AS scope", "concat(case_id, ' passed in baseline, now ', status) AS failure")


WORSE = (
    ("top1_accuracy", "<"), ("false_fault_rate", ">"), ("mean_evidence_support_rate", "<"),
    ("max_unsupported_claim_rate", ">"),
)


def baseline_compare(
    results: DataFrame, aggregates: DataFrame, suite_hash: str, baseline: DataFrame,
    baseline_aggregates: DataFrame, baseline_hash: str, baseline_id: str,
) -> DataFrame:
    """Failure rows against a stored evaluation.

    A different suite is refused. Aggregates count only when the same cases ran: the number of
    cases on both sides must equal the number they share.
    """
    spark = results.sparkSession
    if suite_hash != baseline_hash:
        return spark.createDataFrame(
            [("suite", f"baseline {baseline_id} was produced by a different suite "
                       f"({baseline_hash[:12]} vs {suite_hash[:12]}); re-baseline first")],
            "scope string, failure string")
    now = results.select("case_id", F.lit(True).alias("here"))
    before = baseline.select("case_id", F.lit(True).alias("there"))
    same = now.join(before, "case_id", "full").agg(
        F.expr("coalesce(bool_and(here AND there IS NOT NULL AND here IS NOT NULL), true) AS same"))
    old = baseline_aggregates.select(*[F.col(n).alias(f"b_{n}") for n, _ in WORSE])
    rows = ", ".join(
        f"CASE WHEN same AND {n} {op} b_{n} THEN concat('{n} regressed: ', format_string('%.3f', {n}), "
        f"' vs baseline ', format_string('%.3f', b_{n})) END" for n, op in WORSE)
    worse = aggregates.join(F.broadcast(old)).join(F.broadcast(same)).selectExpr(  # one row each
        "'aggregate' AS scope", f"explode(array_compact(array({rows}))) AS failure")
    return worse.unionByName(baseline_regressions(results, baseline))


def canonical_text(value: str, kind: T.DataType, depth: int = 0) -> str:
    """SQL for a text of ``value`` in which nothing depends on the order things were built in.

    Names of structs and keys of maps are sorted at every depth, and so are lists of strings; other lists keep their order.
    A scalar is its JSON text in brackets, so a number and a text of the same letters differ; null is ``null``.
    """
    x = f"x{depth}"
    if isinstance(kind, T.StructType):
        parts = ", ".join(f"{text(f.name + ':')}, {canonical_text(f'{value}.`{f.name}`', f.dataType, depth)}" + (", ';'" if i < len(kind) - 1 else "")
                          for i, f in enumerate(sorted(kind, key=lambda f: f.name)))
        body = f"concat('{{', {parts}, '}}')"
    elif isinstance(kind, T.MapType):
        entry = f"concat(to_json(array({x}.key)), ':', {canonical_text(f'{x}.value', kind.valueType, depth + 1)})"
        body = f"concat('{{', array_join(array_sort(transform(map_entries({value}), {x} -> {entry})), ';'), '}}')"
    elif isinstance(kind, T.ArrayType):
        items = f"transform({value}, {x} -> {canonical_text(x, kind.elementType, depth + 1)})"
        body = f"concat('(', array_join({f'array_sort({items})' if isinstance(kind.elementType, T.StringType) else items}, ';'), ')')"
    else:
        body = f"IF({value} IS NULL, NULL, to_json(array({value})))"
    return f"coalesce({body}, 'null')"


#: Digits of a digest that one level of the fingerprint tells apart, from the leaves upward.
LEVELS = (12, 9, 6, 3, 0)


def suite_fingerprint(cases: DataFrame) -> DataFrame:
    """One row: content hash of the cases, independent of the order of rows, of string lists and of keys at any depth.

    A tree of digests: cases that share their first 12 digits are hashed together in sorted order, then the digests of up to 4096
    groups that share 9, and so on, so no task holds more than 4096 digests unless cases are repeated.
    """
    whole = canonical_text("c", cases.schema)
    level = cases.select(F.struct(*cases.columns).alias("c")).selectExpr(f"sha2({whole}, 256) AS d").groupBy("d").agg(
        F.count(F.lit(1)).alias("n")).selectExpr("d AS at", "sha2(concat(d, '*', n), 256) AS d", "n")
    for digits in LEVELS:
        level = level.groupBy(F.substring("at", 1, digits).alias("at")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"), F.sum("n").alias("n"))
    return level.select(F.col("d").alias("suite_sha256"), F.col("n").alias("cases"))


def select_cases(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    return cases.join(wanted.select("case_id").distinct(), "case_id", "left_semi")


def unknown_cases(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested ids the suite does not have; any row is an error."""
    return wanted.select("case_id").distinct().join(cases.select("case_id"), "case_id", "left_anti")
