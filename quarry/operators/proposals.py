"""Proposals of public texts: what was left alone must be equal, and every known source text in them explained.

Offsets are code points, start inclusive, end exclusive.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as words
from quarry.operators import fragments
from quarry.sources.work import partitions

#: Bounds of a proposal, relations of a match and the length of its reason, the form of a category.
MOST_TEXT, MOST_OCCURRENCES, MOST_REASON = 1_000_000, 4_000, 2_000
RELATIONS = ("inherited", "unrelated")
CATEGORY = r"^[a-z0-9][a-z0-9-]{0,63}$"


def _slice(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def proposal_codes(targets: DataFrame, proposals: DataFrame, flagged: DataFrame) -> DataFrame:
    """The first fault of each proposal, and of targets without one: (target_id, code), code null where all is well.

    targets: target_id, content. proposals: target_id, content_digest, proposed, occurrences (an
    array of os, oe, ps, pe, category: what stood where, and what stands there now). flagged:
    target_id of the targets that candidates name. What lies between occurrences must be the same in
    both texts, what lies in one must not, and texts are changed just where they are flagged.
    """
    # all steps meet by target, in tasks of bounded size
    n = partitions(targets.sparkSession, max(targets.count(), proposals.count()))
    targets, proposals, flagged = (df.repartition(n, "target_id") for df in (targets, proposals, flagged.select("target_id")))
    known = proposals.join(targets.withColumn("known", F.lit(True)), "target_id", "left").join(flagged.distinct().withColumn("flagged", F.lit(True)), "target_id", "left")
    known = known.withColumn("n_same", F.count("*").over(Window.partitionBy("target_id")))
    keyed = F.array_sort(F.transform("occurrences", lambda x: F.struct(x["os"].alias("os"), x["oe"].alias("oe"), x["ps"].alias("ps"), x["pe"].alias("pe"), x["category"].alias("category"))))
    known = known.withColumn("marks", keyed)
    old, new, marks = F.col("content"), F.col("proposed"), F.col("marks")
    whole = lambda x: functools.reduce(Column.__and__, [x[c].isNotNull() for c in ("os", "oe", "ps", "pe")])
    shaped = F.forall("marks", lambda x: F.coalesce(whole(x) & (x["os"] >= 0) & (x["oe"] > x["os"]) & (x["ps"] >= 0) & (x["pe"] > x["ps"]) & x["category"].rlike(CATEGORY), F.lit(False)))
    inside = F.forall("marks", lambda x: (x["oe"] <= F.length(old)) & (x["pe"] <= F.length(new)))
    # each mark with the one before it
    zipped = F.transform("marks", lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(marks, i - 1)).alias("y")))
    after = lambda p, c: F.coalesce(p["y"][c], F.lit(0))
    ordered = F.forall(zipped, lambda p: (p["x"]["os"] >= after(p, "oe")) & (p["x"]["ps"] >= after(p, "pe")))
    gaps = F.forall(zipped, lambda p: _slice(old, after(p, "oe"), p["x"]["os"]) == _slice(new, after(p, "pe"), p["x"]["ps"]))
    changed = F.forall("marks", lambda x: _slice(old, x["os"], x["oe"]) != _slice(new, x["ps"], x["pe"]))
    last = lambda c: F.coalesce(F.get(marks, F.size("marks") - 1)[c], F.lit(0))
    tail = _slice(old, last("oe"), F.length(old)) == _slice(new, last("pe"), F.length(new))
    code = (
        F.when(F.col("known").isNull(), "target_unknown")
        .when(F.col("n_same") > 1, "target_repeated")
        .when(F.coalesce(F.col("content_digest") != F.sha2(old, 256), F.lit(True)), "content_digest")
        .when(F.coalesce(F.length(new) > MOST_TEXT, F.lit(True)), "proposed_text")
        .when(F.coalesce(F.size("occurrences") > MOST_OCCURRENCES, F.lit(True)) | ~shaped, "occurrence_shape")
        .when(~inside, "occurrence_range")
        .when(~ordered, "occurrence_order")
        .when(~gaps, "gap")
        .when(~changed, "occurrence_unchanged")
        .when(~tail, "tail")
        .when(words.is_credential(new), "credential")
        .when((F.size("marks") > 0) & F.col("flagged").isNull(), "not_flagged")
        .when((F.size("marks") == 0) & F.col("flagged").isNotNull(), "flagged_unchanged")
    )
    missing = targets.join(proposals.select("target_id"), "target_id", "left_anti").select("target_id", F.lit("proposal_missing").alias("code"))
    return known.select("target_id", code.alias("code")).unionByName(missing)


def match_codes(proposals: DataFrame, sources: DataFrame, matches: DataFrame) -> DataFrame:
    """The faults of how known source texts in targets are explained: distinct (target_id, source_id, start, code).

    proposals: target_id (a number), content, proposed, occurrences. sources: source_id (a number), text, category.
    matches: target_id, source_id, start, end, relation, reason. Every place where a source's text stands in a
    target's content wants one match, overlapping places too. An inherited one must lie in an occurrence
    whose new text lacks the source's; a credential can't be unrelated.
    """
    roster = sources.select(F.col("source_id").alias("fragment_id"), F.col("text").alias("fragment"), "category")
    # fragments of equal text are one in the roster: all its sources stand there
    places = fragments.occurrences(proposals, roster, "target_id", "content")
    texts = sources.select("source_id", F.col("text").alias("source_text"), F.col("category").alias("source_category"))
    twins = texts.join(texts.groupBy("source_text").agg(F.min("source_id").alias("fragment_id")), "source_text")
    expected = places.withColumnRenamed("id", "target_id").join(twins, "fragment_id").select("target_id", "source_id", "start", "end", "source_text", "source_category", F.lit(True).alias("expected"))
    keys = ["target_id", "source_id", "start", "end"]
    counted = matches.withColumn("n_same", F.count("*").over(Window.partitionBy(*keys))).withColumn("told", F.lit(True))
    both = expected.join(counted, keys, "full").join(proposals.select("target_id", "proposed", "occurrences"), "target_id", "left")
    shape = F.col("relation").isin(*RELATIONS) & (F.trim("reason") != "") & (F.length("reason") <= MOST_REASON) & (F.col("start") >= 0) & (F.col("end") > F.col("start"))
    secret = F.coalesce(F.col("source_category").rlike(words.CREDENTIAL_CATEGORY), F.lit(False)) | words.is_credential(F.col("source_text"))
    covering = F.get(F.filter("occurrences", lambda x: (x["os"] <= F.col("start")) & (x["oe"] >= F.col("end"))), F.lit(0))
    left = F.contains(_slice(F.col("proposed"), covering["ps"], covering["pe"]), F.col("source_text"))
    code = (
        F.when(F.col("told").isNull(), "match_missing")
        .when(F.col("n_same") > 1, "match_repeated")
        .when(~F.coalesce(shape, F.lit(False)), "match_shape")
        .when(F.col("expected").isNull(), "match_unfounded")
        .when((F.col("relation") == "unrelated") & secret, "credential_unrelated")
        .when((F.col("relation") == "inherited") & covering.isNull(), "not_covered")
        .when((F.col("relation") == "inherited") & left, "still_there")
    )
    return both.select("target_id", "source_id", "start", code.alias("code")).filter("code is not null").distinct()
