"""Privacy spans: validating, thinning, applying and auditing them.

Offsets are code points, start inclusive, end exclusive. Spans are an array per item, sorted
by the functions themselves; folds run inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The categories a finding may have.
CATEGORIES = ("private-personal", "sensitive", "credential", "third-party", "internal-timeline", "confidential")
SPAN = "struct<s:int,e:int,c:string>"


def ordered(spans: Column) -> Column:
    """By start, longer first, then category."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), x["c"].alias("c"))))
    return F.transform(keyed, lambda x: F.struct(x["s"].alias("s"), (-x["ne"]).alias("e"), x["c"].alias("c")))


def without_overlaps(spans: Column) -> Column:
    """Greedy: a span that starts before the end of the last kept one goes."""
    start = F.struct(F.array().cast(f"array<{SPAN}>").alias("kept"), F.lit(0).alias("end"))

    def add(acc, x):
        takes = x["s"] >= acc["end"]
        kept = F.when(takes, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), F.when(takes, x["e"]).otherwise(acc["end"]).alias("end"))

    return F.aggregate(ordered(spans), start, add, lambda acc: acc["kept"])


def applied(text: Column, spans: Column) -> Column:
    """Text with each span as a tag. Overlapping spans give adjacent tags; one wholly inside others gives none; what one has hidden stays hidden."""
    # pieces, joined at the end: a text is copied once, not once for each span
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("done"))

    def add(acc, x):
        gap = F.when(x["s"] > acc["done"], F.substring(text, acc["done"] + 1, x["s"] - acc["done"])).otherwise("")
        tag = F.when(x["e"] > acc["done"], F.concat(F.lit('<redacted category="'), x["c"], F.lit('"/>'))).otherwise("")
        return F.struct(F.concat(acc["out"], F.array(gap, tag)).alias("out"), F.greatest(acc["done"], x["e"]).alias("done"))

    return F.aggregate(ordered(spans), start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["done"] + 1, F.length(text))))


def matches(text: Column, pattern: str, category: str) -> Column:
    """All leftmost matches as spans, from the gaps between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # zipped, so that a text is cut once and not once for each hit
    zipped = F.filter(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), lambda x: x["hit"].isNotNull())
    pairs = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("n")))
    start = F.struct(F.array().cast(f"array<{SPAN}>").alias("found"), F.lit(0).alias("at"))

    def add(acc, x):
        s = acc["at"] + x["gap"]
        return F.struct(F.concat(acc["found"], F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e"), F.lit(category).alias("c")))).alias("found"), (s + x["n"]).alias("at"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, start, add, lambda acc: acc["found"])).otherwise(F.array().cast(f"array<{SPAN}>"))


def rejected(findings: DataFrame, turns: DataFrame) -> DataFrame:
    """Findings (item_id, s, e, category) with the first reason to reject each, null if none."""
    known = findings.join(turns.select("item_id", F.length("content").alias("size")), "item_id", "left")
    reason = (
        F.when(F.col("item_id").isNull(), "missing event id")
        .when(F.col("size").isNull(), "unknown event id")
        .when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "unknown category")
        .when(F.col("s").isNull() | F.col("e").isNull(), "offsets are not integers")
        .when((F.col("s") < 0) | (F.col("s") >= F.col("e")) | (F.col("e") > F.col("size")), "offsets out of range")
    )
    return known.withColumn("reject_reason", reason).drop("size")


WORD = r"[\p{L}\p{N}]+"


def _whole_words(text: Column, start: Column, end: Column) -> Column:
    """Words of ``text`` that lie in [start, end) as wholes."""
    part, before, after = F.substring(text, start + 1, end - start), F.substring(text, start, 1), F.substring(text, end + 1, 1)
    part = F.when((start > 0) & before.rlike(WORD), F.regexp_replace(part, "^" + WORD, "")).otherwise(part)
    part = F.when(after.rlike(WORD), F.regexp_replace(part, WORD + r"\z", "")).otherwise(part)
    return F.regexp_extract_all(part, F.lit(WORD), F.lit(0))


def leaks(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Occurrences of names in texts (item_id, content, spans), covered by a span or leaked, by name.

    Names are words; texts are cut to words once and joined on them, so no name is
    searched in every text. Words carry no places: those that a span covers are the whole words
    of the span's part of the text, less those that an earlier span reaches to.
    """
    text, size = F.col("content"), F.length("content")
    clipped = F.transform("spans", lambda x: F.struct(F.greatest(x["s"], F.lit(0)).alias("s"), F.least(x["e"], size).alias("e")))
    sorted_ = F.array_sort(F.filter(clipped, lambda x: x["s"] < x["e"]))
    kind = "array<struct<s:int,e:int,done:int>>"

    def add(acc, x):
        new = F.struct(x["s"].alias("s"), x["e"].alias("e"), acc["done"].alias("done"))
        more = x["e"] > acc["done"]
        return F.struct(F.when(more, F.concat(acc["parts"], F.array(new))).otherwise(acc["parts"]).alias("parts"), F.greatest(acc["done"], x["e"]).alias("done"))

    parts = F.aggregate(sorted_, F.struct(F.array().cast(kind).alias("parts"), F.lit(0).alias("done")), add, lambda acc: acc["parts"])
    told = lambda words, total, covered: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(total).alias("total"), F.lit(covered).alias("covered")))
    within = F.flatten(F.transform("parts", lambda x: told(_whole_words(text, x["s"], x["e"]), 0, 1)))
    again = F.flatten(F.transform(F.filter("parts", lambda x: x["done"] > x["s"]), lambda x: told(_whole_words(text, x["s"], x["done"]), 0, -1)))
    whole = told(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, 0)
    none = F.array().cast("array<struct<w:string,total:int,covered:int>>")
    rows = texts.select("content", F.coalesce(parts, F.array().cast(kind)).alias("parts"))
    # most texts have no span
    every = F.when(F.size("parts") > 0, F.concat(whole, within, again)).otherwise(F.coalesce(whole, none))
    said = rows.select(F.explode(every).alias("x")).select(F.lower("x.w").alias("name"), "x.total", "x.covered")
    known = names.select("name").distinct()
    few = known.count() <= 100_000
    met = said.join(F.broadcast(known), "name", "left_semi") if few else said
    sums = met.groupBy("name").agg((F.sum("total") - F.sum("covered")).alias("leaks"), F.sum("covered").alias("covered"))
    return sums if few else sums.join(known, "name", "left_semi")
