"""Quality rules with risk-controlled cutoffs, in DataFrame and SQL functions only.

A text fails the base rules when it has under 50 words or when over half of its words stand in
3-word windows that occur more than once. Four ratio rules add to that. Their cutoffs are not
guessed: labelled good documents (``quality`` 1) are the holdout, and a cutoff is taken only if an
exact binomial test shows, at family-wise level ``delta``, that the rule falsely rejects less than
``alpha`` of the good documents of its stratum (``lang``; null is a stratum of its own). Cutoffs of
a rule are tested from the loosest to the tightest and testing stops at the first failure, so the
sequence needs no correction; the level is divided by the number of (rule, stratum) pairs.

The candidate cutoffs are constants, so no labelled row is used for anything but the test.

Defined cases: null text has no words and fails the base rules; a document without label is judged
like any other; a stratum without labelled good documents gets no cutoffs; several labels of a
document count as good only if all are; repeated rows are judged one by one; other columns of the
input are ignored by ``features`` and kept by ``keep_good``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import WORD_GAP
from fleetgauge.session import stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
ALPHA = 0.005
DELTA = 0.05
#: From loose to tight.
CUTOFFS = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01)
#: Rule -> ratio over the base columns; a zero denominator gives null, which no rule rejects.
RULES = {
    "symbols": "try_divide(n_symbols, word_chars)",
    "capitals": "try_divide(n_capitals, word_chars)",
    "lines": "try_divide(n_dup_lines, n_lines)",
    "repeats": "try_divide(n_repeat_words, n_words)",
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "base_failed")


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window which occurs at least twice."""
    windows = F.slice(
        F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))),
        1, F.size(words) - 2)
    ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def repeated(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, j: (x["w"] == F.get(ordered, j - 1)["w"]) | (x["w"] == F.get(ordered, j + 1)["w"]))
        return F.size(F.array_distinct(F.flatten(
            F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    # the sorted array is bound once by the outer transform instead of being built again for every element
    covered = F.element_at(F.transform(F.array(ordered), repeated), 1)
    return (
        F.when(F.size(words) < 4, 0)
        .when(F.size(F.array_distinct(windows)) == F.size(words) - 2, 0)
        .otherwise(covered))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns of ``docs`` with the base columns; one row per row, nothing is shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "")) != "")
    cut = docs.select(*keep, text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    counted = cut.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _without(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _without(F.col("_text"), string.ascii_uppercase).cast("long").alias("n_capitals"))
    return counted.withColumn(
        "base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"))


def _tail(n: Column, k: Column) -> Column:
    """P(X <= k) for X binomial with n trials and rate ALPHA; 1 where k is no less than expected."""
    odds = F.log(F.lit(ALPHA / (1 - ALPHA)))
    start = n * F.log(F.lit(1 - ALPHA))
    zero = F.struct(start.alias("term"), F.exp(start).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<long>"))
    return F.when(k >= n * ALPHA, F.lit(1.0)).otherwise(F.aggregate(terms, zero, step, lambda acc: acc["sum"]))


def stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))


def fit_cutoffs(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """``stratum`` and one cutoff per rule (null: none holds), from base columns with ``doc_id, lang``."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("_good")).where("_good = 1")
    held = judged.where("NOT base_failed").join(good, "doc_id", "left_semi").select(
        stratum().alias("stratum"), *[F.expr(sql).alias(name) for name, sql in RULES.items()])
    counts = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col(name) > c, 1)).alias(f"{name}_{i}") for name in RULES for i, c in enumerate(CUTOFFS)])
    level = counts.withColumn("level", F.lit(DELTA) / (len(RULES) * F.expr("count(*) OVER ()")))

    def tightest(name: str) -> Column:
        tests = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"{name}_{i}").alias("k")) for i, c in enumerate(CUTOFFS)])
        start = F.struct(F.lit(True).alias("on"), F.lit(None).cast("double").alias("cut"))

        def step(acc: Column, x: Column) -> Column:
            on = acc["on"] & (_tail(F.col("n"), x["k"]) <= F.col("level"))
            return F.struct(on.alias("on"), F.when(on, x["c"]).otherwise(acc["cut"]).alias("cut"))

        return F.aggregate(tests, start, step, lambda acc: acc["cut"])

    return level.select("stratum", *[tightest(name).alias(f"cut_{name}") for name in RULES])


def judge(counted: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``kept``. The cutoffs have a row per stratum; whether they are broadcast is left to Spark's size check."""
    rejected = " OR ".join(f"coalesce({sql} > cut_{name}, false)" for name, sql in RULES.items())
    return (
        counted.withColumn("stratum", stratum()).join(cutoffs, "stratum", "left")
        # one expression over both sides of the join: a part of it that is pushed below would repeat the features' work
        .withColumn("kept", F.expr(f"IF(base_failed, false, NOT ({rejected}))")))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, base columns, cutoffs and ``kept`` per document. Texts are read once; the counts are a written table."""
    counted = stored(features(docs, "doc_id", "lang"), "quality")
    return judge(counted, fit_cutoffs(counted, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only.

    Rows are written with their counts, so each text is counted once. The cutoffs are written too: their size is then known when
    they are joined, and whole rows need not be shuffled by stratum.
    """
    row = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "lang", "text")
    counted = stored(features(row, "_row", "doc_id", "lang"), "quality")
    cutoffs = stored(fit_cutoffs(counted, labels), "quality-cutoffs")
    return judge(counted, cutoffs).where("kept").select("_row.*")
