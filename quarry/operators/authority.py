"""Rules that decide: decisions on spans, the release gate, coverage, questions and stages. Each gives the first code that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a reviewed span, and reasons for which a unit may be left out.
STATES = ("deterministic", "needs_confirmation", "confirmed_keep", "confirmed_redact")
REASONS = ("duplicate", "routine_non_narrative", "privacy_withheld")


def decided(state: Column, decision: Column) -> Column:
    """(state, status) after a decision on a span; null where nothing can be decided."""
    open_ = state == "needs_confirmation"
    to = lambda s, status: F.struct(F.lit(s).alias("state"), F.lit(status).alias("status"))
    return F.when(open_ & (decision == "keep"), to("confirmed_keep", "removed")).when(open_ & (decision == "redact"), to("confirmed_redact", "active"))


def review_code(spans: DataFrame, by: list[str]) -> DataFrame:
    """Per group of reviewed spans (state, status): invalid, inconsistent, pending or null, and how many spans there are."""
    valid = F.coalesce(F.col("state").isin(*STATES), F.lit(False))
    fits = F.col("status").eqNullSafe(F.when(F.col("state") == "confirmed_keep", "removed").otherwise("active"))
    found = spans.groupBy(*by).agg(F.count("*").alias("n_spans"), F.bool_and(valid).alias("v"), F.bool_and(fits).alias("f"), F.bool_or(F.coalesce(F.col("state") == "needs_confirmation", F.lit(False))).alias("p"))
    return found.select(*by, "n_spans", F.when(~F.col("v"), "state_invalid").when(~F.col("f"), "state_inconsistent").when(F.col("p"), "pending").alias("review_code"))


def release_code(jobs: DataFrame) -> Column:
    """Why a privacy job does not open the release, in fixed order. Needs status, rejected, completed, total, n_spans, source_digest, receipt_digest, source_revision, now_digest, now_revision, review_code."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    receipt = F.col("receipt_digest").rlike("^[0-9a-f]{64}$") & (F.col("source_revision") > 0) & (F.col("source_revision") <= F.col("now_revision"))
    return (
        F.when(F.col("status").isNull(), "no_job")
        .when(F.coalesce(F.col("rejected"), F.lit(1)) != 0, "rejected")
        .when(F.col("status") != "complete", "not_complete")
        .when((count("completed") != count("total")) | (count("completed") != count("n_spans")), "counts")
        .when(F.coalesce(F.col("source_digest"), F.lit("")) == "", "no_digest")
        .when(~F.coalesce(receipt, F.lit(False)), "receipt")
        .when(F.col("source_digest") != F.col("now_digest"), "changed")
        .otherwise(F.col("review_code"))
    )


def coverage_faults(units: DataFrame, rows: DataFrame, withheld: DataFrame) -> DataFrame:
    """(unit, code) of coverage rows (unit, disposition, owner, reason) that the units (unit, kind, duplicate_of) don't allow.

    ``withheld`` are the units that privacy lets be left out. Each unit needs exactly one row.
    """
    n = rows.groupBy("unit").agg(F.count("*").alias("n"), F.first("disposition").alias("disposition"), F.first("owner").alias("owner"), F.first("reason").alias("reason"))
    known = units.withColumn("known", F.lit(True)).join(withheld.select("unit").distinct().withColumn("private", F.lit(True)), "unit", "left")
    both = known.join(n, "unit", "full_outer")
    shown, reason = F.col("disposition") == "represented", F.col("reason")
    code = (
        F.when(F.col("known").isNull(), "unknown")
        .when(F.col("n").isNull(), "missing")
        .when(F.col("n") > 1, "double_owned")
        .when(shown & (F.col("owner").isNull() | reason.isNotNull()), "invalid")
        .when(~shown & (F.col("owner").isNotNull() | ~F.coalesce(reason.isin(*REASONS), F.lit(False))), "invalid")
        .when((reason == "duplicate") & F.col("duplicate_of").isNull(), "authority")
        .when((reason == "routine_non_narrative") & (F.col("kind") != "routine"), "authority")
        .when((reason == "privacy_withheld") & F.col("private").isNull(), "privacy_authority")
    )
    return both.select("unit", code.alias("code")).filter("code is not null")


def question_code(question: Column, score: Column, options: Column, evidence: Column, foreign: Column, generic: tuple[str, ...]) -> Column:
    """The first fault of a question: text, score, evidence, foreign, options, alike."""
    plain = F.transform(options, lambda o: F.regexp_replace(F.lower(F.trim(o)), r"\.+$", ""))
    return (
        F.when(F.trim(F.coalesce(question, F.lit(""))) == "", "text")
        .when(~F.coalesce(score.between(0, 100), F.lit(False)), "score")
        .when(~F.size(evidence).between(1, 500) | (F.size(F.array_distinct(evidence)) != F.size(evidence)), "evidence")
        .when(foreign, "foreign")
        .when(~F.size(options).isin(2, 3), "options")
        .when((F.size(F.array_distinct(plain)) != F.size(plain)) | F.exists(plain, lambda p: p.isin(*generic)), "alike")
    )


def segments(spans: DataFrame, by: str) -> DataFrame:
    """(by, start, end, ids): the pieces into which the bounds of spans (by, id, s, e) cut their range, with the spans that cover each."""
    packed = spans.filter("s < e").groupBy(by).agg(F.array_sort(F.collect_set(F.struct("s", "e", "id"))).alias("all"))
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda x: F.array(x["s"], x["e"])))))
    cut = packed.withColumn("edges", edges).select(by, "all", F.explode(F.zip_with(F.slice("edges", F.lit(1), F.size("edges") - 1), F.slice("edges", F.lit(2), F.size("edges") - 1), lambda a, b: F.struct(a.alias("s"), b.alias("e")))).alias("p"))
    over = F.transform(F.filter("all", lambda x: (x["s"] <= F.col("p.s")) & (F.col("p.e") <= x["e"])), lambda x: x["id"])
    return cut.select(by, F.col("p.s").alias("start"), F.col("p.e").alias("end"), F.array_sort(F.array_distinct(over)).alias("ids"))
