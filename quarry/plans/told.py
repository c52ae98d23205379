"""Queries over stories, which are made of conversations: their first turns are blocks, their last an insight."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import stories
from quarry.sources.items import table


def story_texts(spark, sf_dir):
    """A story for each turn, as a text; one fault or none by 20 times the conversation's number and the turn."""
    c, t = F.col("conv_id"), F.col("turn")
    n = (c * 20 + t) % 20
    digest = F.sha2(c.cast("string"), 256)
    ref = F.struct(F.concat(F.lit("d"), c).alias("documentId"), F.concat(F.lit("e"), t).alias("eventId"))
    manifest = lambda bad: F.struct(F.when(bad, 0).otherwise(c + 1).alias("revision"), digest.alias("digest"))
    block = lambda k: F.struct(F.concat(F.lit("b"), k).alias("id"), F.when((n == 1), " ").otherwise(F.col("text")).alias("text"), F.array(ref, *[]).alias("evidence"))
    person = F.struct(F.lit("p").alias("id"), F.col("role").alias("releaseLabel"), F.col("role").alias("role"), F.lit("one who speaks").alias("description"), F.when(n == 2, "known").otherwise("local_only").alias("localIdentityState"), F.array(ref).alias("evidence"))
    insight = F.struct(
        F.lit("i").alias("id"), F.col("text").alias("background"), F.lit("b1").alias("anchorStoryBlockId"), F.struct(F.col("text").alias("text"), ref.alias("evidence")).alias("quote"), F.lit("x").alias("directlyAcquiredExperience"), F.lit("y").alias("principle"), F.array(ref).alias("evidence"))
    unit = F.struct(F.lit("u2").alias("unitId"), F.when(n == 3, "other").otherwise("duplicate").alias("reason"))
    kept = F.when(n == 4, F.array(F.lit("u1"), F.lit("u1"))).when(n == 5, F.array(F.lit("u1"), F.lit("u2"))).otherwise(F.array(F.lit("u1")))
    story = F.struct(
        F.lit("story").alias("schema"), F.concat_ws("-", F.lit("k"), c, t).alias("key"), F.when(n == 6, "fr").otherwise("en").alias("language"), F.when(n == 7, "0").otherwise(digest).alias("languagePolicyDigest"), F.struct(F.lit("ph").alias("id"), F.lit("Start").alias("label")).alias("phase"), F.lit("decision").alias("kind"), F.lit("Title").alias("title"), F.col("text").alias("overview"),
        F.array(person).alias("people"), F.struct(F.array(block(F.lit("1")), block(F.when(c % 3 == 0, "1").otherwise("2"))).alias("blocks")).alias("story"), F.array(insight).alias("insights"), F.struct(ref.alias("primary"), F.array().cast("array<struct<documentId:string,eventId:string>>").alias("supporting")).alias("evidence"),
        F.struct(manifest(F.lit(False)).alias("semanticManifest"), manifest(c % 7 == 6).alias("coverageManifest"), kept.alias("representedUnitIds"), F.array(unit).alias("excludedUnits")).alias("coverage"))
    text = F.concat(F.when(c % 11 == 5, "tale:").otherwise("story:"), F.to_json(story))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(c % 13 == 4, F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(',"extra":1,"key":2}'))).otherwise(text).alias("text"))


def t1_story_faults(spark, sf_dir):
    """The faults of every story, with their places."""
    found = stories.story_faults(story_texts(spark, sf_dir), "text").select("conv_id", "turn", F.posexplode("faults").alias("nth", "x"))
    return found.select("conv_id", "turn", F.col("nth").cast("long").alias("nth"), "x.path", "x.code")


T1_SQL = """
with c as (select conv_id, turn, turn % 20 as n, conv_id % 3 = 0 as same, conv_id % 7 = 6 as zero from conversations where conv_id % 11 <> 5 and conv_id % 13 <> 4),
f as (select conv_id, turn, unnest(list_filter([
  case when n = 6 then {'path': '$.language', 'code': 'not_allowed'} end, case when n = 7 then {'path': '$.languagePolicyDigest', 'code': 'form'} end, case when n = 2 then {'path': '$.people[0].localIdentityState', 'code': 'not_allowed'} end,
  case when n = 1 then {'path': '$.story.blocks[0].text', 'code': 'blank'} end, case when n = 1 then {'path': '$.story.blocks[1].text', 'code': 'blank'} end, case when same and n <> 1 then {'path': '$.story.blocks', 'code': 'repeated'} end,
  case when zero then {'path': '$.coverage.coverageManifest.revision', 'code': 'out_of_range'} end, case when n = 4 then {'path': '$.coverage.representedUnitIds', 'code': 'repeated'} end, case when n = 3 then {'path': '$.coverage.excludedUnits[0].reason', 'code': 'not_allowed'} end,
  case when n = 5 and not zero then {'path': '$.coverage.excludedUnits', 'code': 'represented_too'} end], lambda x: x is not null)) as x, from c),
r as (select conv_id, turn, row_number() over () as pos, x from f)
select conv_id, turn, row_number() over (partition by conv_id, turn order by pos) - 1 as nth, x.path as path, x.code as code from r
union all select conv_id, turn, 0, '$', case when conv_id % 11 = 5 then 'prefix' else 'duplicate_key' end from conversations where conv_id % 11 = 5 or conv_id % 13 = 4
"""

QUERIES = {"t1_story_faults": t1_story_faults}
ORACLE = {"t1_story_faults": T1_SQL}
