"""Queries over packages of stories: a conversation is a package, each four places of its turns a chapter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import packages
from quarry.sources.items import table
from quarry.sources.work import written


def t3_package_codes(spark, sf_dir):
    """The first failure of every conversation's package; one planted or none by the conversation's number."""
    turns = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    turns = turns.withColumn("k", F.dense_rank().over(Window.partitionBy("conv_id").orderBy(F.floor(F.col("turn") / 4))).cast("long") - 1)
    chapter = turns.groupBy("conv_id", "k").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.min_by("text", "turn").alias("text"))
    chapter = written(chapter.withColumn("last", F.max("k").over(Window.partitionBy("conv_id"))), "chapters")
    c, k, turn = F.col("conv_id"), F.col("k"), F.col("turns")
    f = F.pmod(c, F.lit(16))
    hit = lambda n: (f == n) & (k == F.col("last"))
    doc, digest = F.concat(F.lit("d"), c), F.sha2(c.cast("string"), 256)
    ref = lambda e: F.struct(doc.alias("documentId"), e.alias("eventId"))
    event = lambda t: F.concat(F.lit("e"), t)
    every = F.transform("turns", lambda t: ref(event(t)))
    more = F.slice(every, F.lit(2), F.size(every))
    more = F.when(hit(9), F.concat(more, F.array(ref(F.lit("none"))))).when(hit(10), F.concat(more, F.array(ref(F.lit("x"))))).otherwise(more)
    key = F.concat_ws("-", F.lit("k"), c, F.when(hit(3), F.lit(0)).otherwise(k))
    unit = F.concat_ws("-", F.lit("u"), c, k)
    who = F.array_sort(F.array_distinct(F.transform("turns", lambda t: F.pmod(t, F.lit(2)))))
    person = lambda p: F.struct(p.cast("string").alias("id"), F.lit("P").alias("releaseLabel"), F.lit("r").alias("role"), F.lit("d").alias("description"), F.lit("local_only").alias("localIdentityState"), F.transform(F.filter(turn, lambda t: F.pmod(t, F.lit(2)) == p), lambda t: ref(event(t))).alias("evidence"))
    people = F.transform(F.filter(who, lambda p: ~hit(11)), person)
    phase = F.when(hit(8), F.lit(0)).otherwise(F.floor(k / 2))
    quote = F.when(hit(12), F.concat(F.lit("never said: "), F.substring("text", 1, 40))).otherwise(F.concat(F.lit("said: "), F.substring("text", 1, 40)))
    first = ref(event(turn[0]))
    insight = F.struct(F.lit("i").alias("id"), F.lit("b").alias("background"), F.lit("b1").alias("anchorStoryBlockId"), F.struct(quote.alias("text"), first.alias("evidence")).alias("quote"), F.lit("x").alias("directlyAcquiredExperience"), F.lit("y").alias("principle"), F.array(first).alias("evidence"))
    manifest = lambda bad: F.struct(F.when(bad, 2).otherwise(1).alias("revision"), digest.alias("digest"))
    out = F.when(hit(10), F.array(F.struct(F.lit("ux").alias("unitId"), F.lit("duplicate").alias("reason")))).otherwise(F.array().cast("array<struct<unitId:string,reason:string>>"))
    story = F.struct(
        F.lit("story").alias("schema"), key.alias("key"), F.lit("en").alias("language"), F.when(hit(4), F.sha2(key, 256)).otherwise(digest).alias("languagePolicyDigest"), F.struct(F.concat(F.lit("p"), phase).alias("id"), F.when(hit(7), "General work").otherwise(F.concat(F.lit("Part "), phase)).alias("label")).alias("phase"),
        F.lit("T").alias("title"), F.lit("O").alias("overview"), people.alias("people"), F.struct(F.array(F.struct(F.lit("b1").alias("id"), F.lit("t").alias("text"), every.alias("evidence"))).alias("blocks")).alias("story"), F.array(insight).alias("insights"),
        F.struct(first.alias("primary"), more.alias("supporting")).alias("evidence"), F.struct(manifest(hit(5)).alias("semanticManifest"), manifest(F.lit(False)).alias("coverageManifest"), F.array(unit).alias("representedUnitIds"), out.alias("excludedUnits")).alias("coverage"))
    stories = chapter.filter(f != 15).select(c.alias("package"), k.alias("place"), F.when(hit(2), "e").otherwise(event(turn[0])).alias("id"), doc.alias("document_id"), F.concat(F.when(hit(1), "tale:").otherwise("story:"), F.to_json(story)).alias("summary"))
    said = lambda rows, e, t, text: rows.select(c.alias("package"), doc.alias("document_id"), e.alias("event_id"), F.lit("human").alias("actor_type"), F.lit("message").alias("event_type"), F.concat(F.lit("a"), t).alias("actor_id"), F.concat(F.lit("said: "), text).alias("narrative"))
    tens = chapter.filter((f == 10) & (k == 0))
    evidence = said(turns, event(F.col("turn")), F.pmod("turn", F.lit(2)), F.col("text")).union(said(tens, F.lit("x"), F.lit(0), F.lit("")))
    units = chapter.select(c.alias("package"), unit.alias("unit_id"), F.explode(F.when(hit(13), F.array(F.lit("z"))).otherwise(F.transform("turns", event))).alias("member")).union(tens.select("conv_id", F.lit("ux"), F.lit("x")))
    coverage = chapter.select(c.alias("package"), unit.alias("unit_id"), F.lit("represented").alias("disposition"), F.when(hit(6), "k").otherwise(key).alias("owner_id"), F.lit(None).cast("string").alias("reason"))
    coverage = coverage.union(tens.select("conv_id", F.lit("ux"), F.lit("excluded"), F.lit(None).cast("string"), F.lit("duplicate")))
    manifests = chapter.filter(k == 0).select(
        c.alias("package"), F.lit(1).alias("semantic_revision"), digest.alias("semantic_digest"), F.lit(1).alias("coverage_revision"), digest.alias("coverage_digest"), F.lit(1).alias("covers_revision"), F.when(f == 14, "0").otherwise(digest).alias("covers_digest"))
    return packages.package_codes(stories, evidence, units, coverage, manifests)


T3_SQL = """
with t as (select conv_id as c, conv_id % 16 as f, dense_rank() over (partition by conv_id order by floor(turn / 4)) - 1 as k from conversations where conv_id is not null and turn is not null),
p as (select c, f, max(k) as m from t group by c, f),
x as (select c, m, case f when 1 then 'STORY_CHAPTER_INVALID' when 2 then 'STORY_EVIDENCE_INVALID' when 3 then case when m > 0 then 'STORY_KEY_DUPLICATED' end when 4 then case when m > 0 then 'STORY_LANGUAGE_INVALID' end
  when 5 then 'STORY_SEMANTIC_AUTHORITY_STALE' when 6 then 'STORY_COVERAGE_INVALID' when 7 then 'STORY_PHASE_INVALID' when 8 then case when m > 2 then 'STORY_PHASE_ORDER_INVALID' end when 9 then 'STORY_EVIDENCE_INVALID'
  when 10 then 'STORY_EXCLUDED_EVIDENCE_INVALID' when 11 then 'STORY_PEOPLE_INVALID' when 12 then 'STORY_INSIGHT_GROUNDING_INVALID' when 13 then 'STORY_COVERAGE_INVALID' when 14 then 'STORY_SEMANTIC_AUTHORITY_STALE' when 15 then 'STORY_CANDIDATE_MISSING' end as code, f from p)
select c as package, code, case when code is not null and f < 14 then m end as place from x
"""

QUERIES = {"t3_package_codes": t3_package_codes}
ORACLE = {"t3_package_codes": T3_SQL}
