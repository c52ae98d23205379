"""Queries over items, units and runs: projection rules, lookups between relations, counters, order and sets.

Orders stand for units, lines for members, customers for owners, parts for questions.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import records as rec
from quarry.functions import text as txt
from quarry.operators import projection
from quarry.plans.evidence import dealt, dealt_values
from quarry.sources.items import conversation_items, event_items, items, table

FIELDS = {
    "event_type": ["message", "tool_call", "reasoning", "agent", "artifact", "record", "system", "progress", "git", "speech", "tool_result", "other"],
    "actor": ["human", "ai", "assistant", "user", "tool", None, "Speaker"],
    "record_type": [None, "thinking", "sub_agent_activity", "agent_message", "x"],
    "direction": [None, "agent_to_agent", "user_to_agent"],
    "text": ["hello", "", "Ran commands.", None, " read files,  ran commands!"],
    "kind": ["image", "log", None],
    "role": [None, "assistant", "user", ""],
    "interaction": [None, "correction", "chat"],
}


def _picked(k: str, n: int) -> str:
    return f"floor(event_id / {n}) % {len(FIELDS[k])}"


_STEPS = dict(zip(FIELDS, (1, 12, 3, 5, 7, 11, 13, 17), strict=True))


def p1_source_dispositions(spark, sf_dir):
    """Events whose fields run through many combinations; an artifact's maker is kept where its number is odd."""
    rows = table(spark, sf_dir, "events").select("event_id", *[F.get(F.array(*[F.lit(x) for x in v]), F.expr(f"cast({_picked(k, _STEPS[k])} as int)")).alias(k) for k, v in FIELDS.items()])
    odd, third = F.col("event_id") % 2 == 1, F.col("event_id") % 3 == 0
    found = projection.source_disposition(*[F.col(k) for k in ("event_type", "actor", "record_type", "direction", "text", "kind")], odd, F.col("role"), F.col("interaction"), third)
    return rows.select("event_id", found.alias("disposition"))


_PICKS = ", ".join(f"[{', '.join('null' if x is None else repr(x) for x in v)}][cast({_picked(k, _STEPS[k])} as int) + 1] as {k}" for k, v in FIELDS.items())
_MARKER = r"regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[.! ]+$', '') in ('loaded a tool, ran commands', 'read files, ran commands', 'ran commands')"


def p6_pseudonyms(spark, sf_dir):
    """Actors of conversations by opaque names; one name never stands for two actors."""
    named = conversation_items(spark, sf_dir).select("document_id", "actor_type", rec.pseudonym("actor", "document_id", "actor_type").alias("name"))
    return named.groupBy("name").agg(F.countDistinct("document_id", "actor_type").alias("n_actors"), F.count("*").alias("n_items"))


DIRECTIONS = [(1, "a", "a"), (2, "a", None), (3, None, "b"), (4, "a", "b"), (5, None, None), (6, "x", "x")]


def p7_directions(spark, sf_dir):
    rows = dealt(spark, sf_dir, DIRECTIONS, "id int, payload string, source string")
    clash = F.coalesce(F.col("payload") != F.col("source"), F.lit(False))
    way = F.coalesce("payload", "source")
    return rows.select("id", F.when(clash, "conflict").when(way.isNotNull() & ~way.isin("a", "b"), "not_allowed").otherwise(F.coalesce(way, F.lit("none"))).alias("direction"))


def p8_source_ids(spark, sf_dir):
    ids = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("line-"), "event_id")).when(F.col("event_id") % 7 == 0, F.concat(F.lit("line-"), "event_id", F.lit(":2"))).when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat(F.lit("r"), "event_id"))
    return table(spark, sf_dir, "events").select("event_id", rec.stable_record_id(ids).alias("record_id"))


def p9_contents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.substring("text", 1, 20)).alias("text"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("message"), F.col("source").alias("note"))
    return rows.select("doc_id", rec.first_filled("text", "message", "note").alias("content"))


def p10_release_items(spark, sf_dir):
    """Items as they are released: conversation in full, all else a label; records without clock and actor."""
    found = items(spark, sf_dir).withColumn("event_type", F.when((F.col("event_type") == "message") & (F.col("sequence") % 4 == 0), "record").otherwise(F.col("event_type")))
    talks = F.col("event_type").isin(*projection.RELEASED)
    actor = F.when(F.col("event_type") == "record", "participant").when(talks, F.coalesce("actor_type", F.lit("participant"))).otherwise("tool")
    return found.select("item_id", F.when(talks, F.col("event_type")).otherwise("action_label").alias("event_type"), actor.alias("actor_type"), F.when(talks, F.sha2("content", 256)).otherwise(projection.release_label(F.col("event_type"))).alias("content"))


def p13_sequences(spark, sf_dir):
    """Conversations whose remaining turns are not numbered 1 to n."""
    turns = table(spark, sf_dir, "conversations").filter((F.col("conv_id") % 5 != 0) | (F.col("turn") != 2)).withColumn("seq", F.col("turn") + 1)
    found = turns.groupBy("conv_id").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.countDistinct("seq").alias("d"), F.count("*").alias("n"))
    return found.filter("a <> 1 or b <> n or d <> n").select("conv_id", "n")


def p14_corpus_faults(spark, sf_dir):
    """(code, id) of all that keeps turns and their documents from being one corpus; faults are planted by number."""
    turns = conversation_items(spark, sf_dir).withColumn("n", F.regexp_extract("document_id", r"(\d+)", 1).cast("long"))
    rows = turns.select(
        "document_id", "n", F.when((F.col("n") % 17 == 3) & (F.col("sequence") == 2), "bad id!").otherwise(F.col("item_id")).alias("item_id"),
        F.when((F.col("n") % 13 == 4) & (F.col("sequence") == 3), 2).otherwise(F.col("sequence")).alias("sequence"),
    )
    told = rows.groupBy("document_id", "n").agg(F.count("*").alias("size")).withColumn("told", F.when(F.col("n") % 11 == 5, F.col("size") + 1).otherwise(F.col("size")))
    fault = lambda df, code, of: df.select(F.lit(code).alias("code"), F.col(of).alias("id"))
    odd = fault(rows.filter(~F.col("item_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9:._-]*$")), "item_id_invalid", "document_id")
    twice = fault(rows.groupBy("item_id").agg(F.count("*").alias("k")).filter("k > 1"), "item_id_repeated", "item_id")
    clash = fault(rows.groupBy("document_id", "sequence").agg(F.count("*").alias("k")).filter("k > 1"), "sequence_repeated", "document_id")
    count = fault(told.filter("told <> size"), "item_count", "document_id")
    alien = fault(rows.filter(~F.col("item_id").startswith("conv-") & F.col("item_id").rlike("^[A-Za-z0-9:._-]+$")), "foreign_item", "document_id")
    return odd.unionByName(twice).unionByName(clash).unionByName(count).unionByName(alien)


TEXTS = [(1, "fine"), (2, ""), (3, "  "), (4, "tab\there"), (5, "äöü" * 5), (6, None), (7, "x" * 16), (8, "x" * 17)]


def p15_bounded_texts(spark, sf_dir):
    rows = dealt(spark, sf_dir, TEXTS, "id int, text string")
    return rows.select("id", rec.bounded_text(F.col("text"), 16).alias("ok"))


def p18_masked_reasons(spark, sf_dir):
    """Reasons that name a unit or belong to the story family are replaced when released."""
    reason = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("semantic-unit:"), "p_partkey")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("project.story/"), "p_brand")).otherwise(F.col("p_type"))
    masked = F.when(reason.startswith("semantic-unit:"), "Project event").when(reason.startswith("project.story"), "Story evidence").otherwise(reason)
    return table(spark, sf_dir, "part").select("p_partkey", masked.alias("reason"))


OBJECTS = [(1, '{"id":1,"text":"a"}'), (2, '{"id":1}'), (3, '{"id":1,"text":"a","x":0}'), (4, "[]"), (5, '{"text":"a","id":null}')]


def p19_exact_keys(spark, sf_dir):
    keys, want = F.json_object_keys("raw"), F.array(F.lit("id"), F.lit("text"))
    exact = (F.size(F.array_except(keys, want)) == 0) & (F.size(F.array_except(want, keys)) == 0)
    return dealt(spark, sf_dir, OBJECTS, "id int, raw string").select("id", F.coalesce(exact, F.lit(False)).alias("exact"))


def p21_null_safe(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.nullif("quality", F.lit(0)).alias("a"), F.nullif("toxic", F.lit(0)).alias("b"))
    return rows.groupBy(F.col("a").eqNullSafe(F.col("b")).alias("same")).agg(F.count("*").alias("n"))


def j2_latest_receipts(spark, sf_dir):
    """Customers with the number of their latest order, by date and key; null without one."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "latest")


def j3_run_items(spark, sf_dir):
    """The one run's facts beside every item; the run stays where no item does."""
    run = spark.range(1).select(F.lit("run-1").alias("run"))
    none = conversation_items(spark, sf_dir).filter("role = 'nobody'").select("item_id")
    some = conversation_items(spark, sf_dir).filter("role = 'system'").select("item_id")
    beside = lambda found: F.broadcast(run).join(found, F.lit(True), "left")
    return beside(none).unionByName(beside(some))


def j5_currency(spark, sf_dir):
    """Units whose stored count, digest and revision agree with their members."""
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.expr("case when o_orderkey % 6 = 0 then 3 else 1 end").alias("revision"))
    now = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.count("*").alias("n"), F.max("l_linenumber").cast("long").alias("top"))
    return stored.join(now, "unit", "left").select("unit", ((F.col("revision") == 1) & (F.col("n") == F.col("top"))).alias("current"))


def j6_span_units(spark, sf_dir):
    """Redacted members and the units that hold them."""
    spans = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("unit"))
    return spans.join(members, ["l_orderkey", "l_linenumber"]).groupBy("unit").agg(F.count("*").alias("n_spans"))


def j9_candidates(spark, sf_dir):
    """Candidates that name an item: identity fields come from the item; unknown and repeated ones are refused."""
    asked = table(spark, sf_dir, "conversations").select(F.expr("'conv-' || conv_id || ':turn-' || (turn + case when conv_id % 4 = 0 then 1 else 0 end - case when conv_id % 9 = 0 and turn > 0 then 1 else 0 end)").alias("item_id"))
    asked = asked.groupBy("item_id").agg(F.count("*").alias("n"))
    known = conversation_items(spark, sf_dir).select("item_id", "actor_type")
    return asked.join(known, "item_id", "left").select("item_id", F.when(F.col("actor_type").isNull(), "unknown").when(F.col("n") > 1, "repeated").otherwise(F.col("actor_type")).alias("found"))


def j10_exact_rows(spark, sf_dir):
    """Units and coverage rows that do not match one to one."""
    units = table(spark, sf_dir, "orders").filter("o_orderkey % 50 <> 1").select(F.col("o_orderkey").alias("unit"))
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 50 <> 2").select(F.explode(F.array_repeat("o_orderkey", F.when(F.col("o_orderkey") % 40 == 3, 2).otherwise(1))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    both = units.withColumn("known", F.lit(True)).join(rows, "unit", "full_outer")
    return both.select("unit", F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").alias("code")).filter("code is not null")


def j11_narratives(spark, sf_dir):
    """Owners with the members of their open units, in order, as a digest."""
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    told = open_.join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")
    packed = told.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("all"))
    return packed.select("o_custkey", F.size("all").cast("long").alias("n"), F.sha2(F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["l_orderkey"], x["l_linenumber"])), ","), 256).alias("digest"))



def j17_grounded_claims(spark, sf_dir):
    """Claims cut from turns: grounded where the normalised claim stands in the cited turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    claims = turns.select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.col("turn") + 1).otherwise(F.col("turn")).alias("turn"), F.concat(F.lit("  "), F.substring("text", 5, 24), F.lit(" !")).alias("claim"))
    held = F.contains(txt.claim_normal(F.col("text")), F.trim(txt.claim_normal(F.col("claim"))))
    return claims.join(turns, ["conv_id", "turn"], "left").groupBy("conv_id").agg(F.count_if(F.coalesce(held, F.lit(False))).alias("n_grounded"), F.count("*").alias("n_claims"))


_CLAIM = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_./:+-]+', ' ', 'g'), ' +', ' ', 'g'))"


def j18_copied_units(spark, sf_dir):
    """Members with a field copied from their unit, or a default."""
    named = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return table(spark, sf_dir, "lineitem").join(named, "l_orderkey", "left").groupBy(F.coalesce("o_orderpriority", F.lit("Unclassified")).alias("category")).agg(F.count("*").alias("n"))


def a4_conservation(spark, sf_dir):
    """Documents whose counters do not add up: raw less replays is normalized, normalized less kept is dropped. One in nine tells a wrong number, one in eleven more documents than there were."""
    rows = event_items(spark, sf_dir).withColumn("n", F.col("sequence"))
    per = rows.groupBy("document_id").agg(F.count("*").alias("raw"), F.countDistinct("event_type", F.floor(F.col("n") / 7)).alias("normalized"))
    kept = rows.filter("event_type in ('artifact', 'system')").groupBy("document_id").agg(F.countDistinct("event_type", F.floor(F.col("n") / 7)).alias("kept"))
    dropped = rows.filter("event_type not in ('artifact', 'system')").groupBy("document_id").agg(F.countDistinct("event_type", F.floor(F.col("n") / 7)).alias("dropped"))
    user = F.regexp_extract("document_id", r"(\d+)", 1).cast("long")
    told = per.join(kept, "document_id", "left").join(dropped, "document_id", "left").fillna(0).withColumn("kept", F.col("kept") + (user % 9 == 0).cast("int")).withColumn("normalized", F.when(user % 11 == 0, F.col("raw") + 1).otherwise(F.col("normalized")))
    code = F.when(F.col("normalized") > F.col("raw"), "replays").when(F.col("normalized") - F.col("kept") != F.col("dropped"), "dropped")
    return told.select("document_id", code.alias("code")).filter("code is not null")


def a10_guards(spark, sf_dir):
    """Counts of several tables as one row, and whether they agree with what was told."""
    n = {t: table(spark, sf_dir, t).agg(F.count("*").alias(t)) for t in ("orders", "customer", "labels")}
    return F.broadcast(n["orders"]).join(n["customer"], F.lit(True)).join(n["labels"], F.lit(True)).select("orders", "customer", "labels", (F.col("orders") == F.col("customer") * 10).alias("agrees"))


def a15_projects(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("project", F.concat(F.lit("project-"), F.length("document_id") % 4, F.lit("-"), "event_type"))
    found = rows.groupBy("project").agg(F.count("*").alias("n_events"), F.min("item_id").alias("first_item"))
    return found.select("project", "n_events", "first_item", (F.row_number().over(Window.orderBy(F.desc("n_events"), "project")) == 1).alias("primary_project"))


def a16_document_starts(spark, sf_dir):
    stamp = F.when(F.col("user_id") % 3 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.min(stamp), F.lit("2024-06-30T00:00:00")).alias("starts"))


def a19_review_summary(spark, sf_dir):
    """Edits by chapter: an order is a chapter, its lines are edits."""
    op = F.get(F.array(*[F.lit(x) for x in ("delete", "revise", "add")]), F.col("l_linenumber") % 3)
    pending, needs = F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    counts = [F.count_if(op == k).alias(f"n_{k}") for k in ("delete", "revise", "add")]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*counts, F.count_if(pending).alias("n_pending"), F.count_if(needs).alias("n_needs_evidence"), F.count_if(pending | needs).alias("n_unresolved"))


def a21_privacy_totals(spark, sf_dir):
    """Kinds with their counts, and whether the counts add up to what was told in all."""
    kinds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n")).filter("n > 0")
    packed = kinds.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))).alias("counts"), F.sum("n").alias("total"))
    return packed.join(F.broadcast(table(spark, sf_dir, "lineitem").agg(F.count("*").alias("told"))), F.lit(True)).select("counts", "total", (F.col("told") == F.col("total")).alias("agrees"))


def w6_phases(spark, sf_dir):
    """Phases of each user that come up again after another had begun."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumn("phase", F.floor(F.dayofmonth("ts") / 10) + F.when(F.col("event_id") % 211 == 0, 1).otherwise(0))
    rows = rows.withColumn("starts", (~F.lag("phase").over(w).eqNullSafe(F.col("phase"))).cast("int"))
    return rows.groupBy("user_id", "phase").agg(F.sum("starts").alias("islands")).filter("islands > 1")


def w8_context(spark, sf_dir):
    """Twenty letters on each side of a turn's first word, from the turns around it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before, after = F.coalesce(F.lag("text").over(w), F.lit("")), F.concat(F.col("text"), F.coalesce(F.lead("text").over(w), F.lit("")))
    word = F.regexp_extract("text", r"^\S*", 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.right(before, F.lit(20)).alias("left_context"), word.alias("word"), F.substr(after, F.length(word) + 1, F.lit(20)).alias("right_context"))


def o5_documents_listing(spark, sf_dir):
    """The first fifty documents of the listing, unknown clocks first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.col("n_chars")).alias("clock"), "source")
    return rows.orderBy(F.asc_nulls_first("clock"), "source", "doc_id").limit(50).select("doc_id")


def o10_probe_cap(spark, sf_dir):
    """Twenty questions at most, one for each insight: the best by score, then date, then id."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    best = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))
    return rows.withColumn("nth", best).filter("nth = 1").orderBy(F.desc("p_size"), "p_partkey").limit(20).select("p_partkey", "p_brand")


def o11_longest_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return rows.orderBy(F.desc("n"), "doc_id").limit(25).select("doc_id", F.col("n").cast("long").alias("n"))


def u1_known_ids(spark, sf_dir):
    ids = lambda t, c: table(spark, sf_dir, t).select(F.col(c).cast("long").alias("id"))
    return ids("documents", "doc_id").union(ids("labels", "doc_id")).union(ids("pages", "page_id")).distinct()


def u3_shards(spark, sf_dir):
    """Shards against their universe: items in several shards, in none, or unknown."""
    universe = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    shards = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 301 == 0, 10_000_000).otherwise(0)).alias("id"), (F.col("o_custkey") % 7 + (F.col("o_orderkey") % 400 == 3).cast("int")).alias("shard"))
    per = shards.groupBy("id").agg(F.countDistinct("shard").alias("n"))
    both = universe.withColumn("known", F.lit(True)).join(per, "id", "full_outer")
    return both.select("id", F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "overlap").alias("code")).filter("code is not null")


def u4_key_sets(spark, sf_dir):
    """Users whose reported types are not those observed."""
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    said = table(spark, sf_dir, "events").filter("user_id % 5 <> 0 or event_type not in ('error', 'view')").groupBy("user_id").agg(F.collect_set("event_type").alias("b"))
    differ = lambda x, y: F.array_sort(F.array_except(x, y))
    both = seen.join(said, "user_id", "left").withColumn("b", F.coalesce("b", F.array().cast("array<string>")))
    return both.select("user_id", F.array_join(differ("a", "b"), ",").alias("unreported")).filter("unreported <> ''")


def u7_merged_units(spark, sf_dir):
    """Proposals of one unit from several shards: merged where their label agrees, else a conflict."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_orderkey") % 10 == 0, F.col("l_linestatus")).otherwise("x").alias("label"), "l_linenumber")
    found = rows.groupBy("l_orderkey").agg(F.countDistinct("label").alias("labels"), F.array_join(F.array_sort(F.collect_set("l_linenumber")), ",").alias("members"))
    return found.select("l_orderkey", F.when(F.col("labels") == 1, F.col("members")).otherwise("conflict").alias("members"))


SPACED = [(1, "  a "), (2, " b "), (3, "﻿c\n"), (4, "​d"), (5, "\t\r\n"), (6, "e　f")]
_ES = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def n4_trimmed(spark, sf_dir):
    cut = F.regexp_replace("text", rf"^[{_ES}]+|[{_ES}]+$", "")
    return dealt(spark, sf_dir, SPACED, "id int, text string").select("id", F.hex(F.encode(cut, "UTF-8")).alias("trimmed"))


def n16_categories(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.concat("p_brand", F.lit(" API-Key"))).when(F.col("p_size") % 5 == 1, "PrivateKey").when(F.col("p_size") % 5 == 2, "tokens").otherwise(F.col("p_type")).alias("category"))
    return rows.groupBy(F.col("category").rlike(txt.CREDENTIAL_CATEGORY).alias("credential")).agg(F.count("*").alias("n"))


PHASES = ["Kick off", "project update", "Very long label here", "Fix-up", "Later Stage", "Ünicode", "A1 b2", "two  spaces", "", "other"]


def n18_phase_labels(spark, sf_dir):
    generic = ("project evolution", "project update", "workflow progress", "general work", "other", "later stage")
    rows = dealt(spark, sf_dir, list(enumerate(PHASES)), "id int, label string")
    return rows.select("id", "label", (F.col("label").rlike(r"^[A-Za-z0-9]+([-'][A-Za-z0-9]+)*(\s+[A-Za-z0-9]+([-'][A-Za-z0-9]+)*)?$") & ~F.lower("label").isin(*generic)).alias("ok"))


CATEGORY = ["credential", "Bad", "third-party", "", None, "-x", "a" * 64, "a" * 65, "9lives"]


def n20_safe_categories(spark, sf_dir):
    rows = dealt(spark, sf_dir, list(enumerate(CATEGORY)), "id int, category string")
    return rows.select("id", txt.safe_category(F.col("category")).alias("category"))


TITLES = [(1, "transcript_2024-02-29_10.11.12", "x"), (2, "transcript_2023-02-29_10.11.12", "x"), (3, "transcript_2024-01-01_00.00.00", "transcript_2024-01-02_00.00.00"), (4, "none", "pre transcript_2024-05-06_07.08.09.txt"), (5, "a", "b")]


def d3_transcript_days(spark, sf_dir):
    """The one real day named by a title and an id; null where there is none or two."""
    rows = dealt(spark, sf_dir, TITLES, "id int, title string, name string")
    day = lambda c: F.try_to_date(F.nullif(F.regexp_extract(c, r"transcript_(\d{4}-\d{2}-\d{2})_\d{2}\.\d{2}\.\d{2}", 1), F.lit("")), "yyyy-MM-dd")
    days = F.array_distinct(F.array_compact(F.array(day("title"), day("name"))))
    return rows.select("id", F.when(F.size(days) == 1, F.get(days, F.lit(0))).alias("day"))


def d6_stale_leases(spark, sf_dir):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("ts") <= now, F.col("ts"))).alias("at")).select("user_id", F.coalesce(F.col("at") <= now - F.expr("interval 30 minutes"), F.lit(True)).alias("stale"))


def d7_suppressed_clocks(spark, sf_dir):
    """A document with one span of the timeline category loses all its clocks."""
    hidden = table(spark, sf_dir, "events").filter("event_type = 'error' and event_id % 19 = 0").select("user_id").distinct().withColumn("hidden", F.lit(True))
    rows = table(spark, sf_dir, "events").join(hidden, "user_id", "left")
    return rows.groupBy("user_id").agg(F.count(F.when(F.col("hidden").isNull(), F.col("ts"))).alias("n_clocks"))


def m1_shard_counts(spark, sf_dir, most_bytes=20_000, most_rows=7):
    """How many shards each source needs: by bytes of records, bytes of content, and rows."""
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text") + 40).alias("a"), F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"))
    need = F.greatest(F.lit(1), F.ceil(F.col("a") / most_bytes), F.ceil(F.col("b") / most_bytes), F.ceil(F.col("n") / most_rows))
    return per.select("source", need.cast("long").alias("n_shards"))


def r1_arrays(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("all"))
    return per.select("user_id", F.array_join(F.slice(F.array_sort(F.array_distinct("all")), 1, 3), ",").alias("first_types"), F.size(F.filter("all", lambda x: x == "view")).cast("long").alias("n_views"))


def r2_merged_counters(spark, sf_dir):
    """Counter maps of users summed by key over the run, in one sorted map."""
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    total = per.select(F.explode("m").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    return total.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("counters"))


QUERIES = {f.__name__: f for f in (
    p1_source_dispositions, p6_pseudonyms, p7_directions, p8_source_ids, p9_contents, p10_release_items, p13_sequences, p14_corpus_faults, p15_bounded_texts, p18_masked_reasons, p19_exact_keys, p21_null_safe,
    j2_latest_receipts, j3_run_items, j5_currency, j6_span_units, j9_candidates, j10_exact_rows, j11_narratives, j17_grounded_claims, j18_copied_units,
    a4_conservation, a10_guards, a15_projects, a16_document_starts, a19_review_summary, a21_privacy_totals, w6_phases, w8_context, o5_documents_listing, o10_probe_cap, o11_longest_first,
    u1_known_ids, u3_shards, u4_key_sets, u7_merged_units, n4_trimmed, n16_categories, n18_phase_labels, n20_safe_categories, d3_transcript_days, d6_stale_leases, d7_suppressed_clocks, m1_shard_counts, r1_arrays, r2_merged_counters,
)}

_EV = "case event_type when 'view' then 'tool_call' when 'click' then 'tool_call' when 'error' then 'tool_result' when 'signup' then 'system' when 'purchase' then 'artifact' else event_type end"
ORACLE = {
    "p1_source_dispositions": f"""with r as (select event_id, {_PICKS} from events), f as (select *, trim(coalesce(text, '')) = '' as blank, coalesce({_MARKER}, false) as marker, lower(coalesce(actor, '')) as who, coalesce(direction, '') = 'agent_to_agent' as tog, event_type in ('message', 'record', 'speech') as spoken,
      event_type = 'agent' or coalesce(record_type, '') = 'sub_agent_activity' as agent from r)
      select event_id, case when event_type in ('tool_call', 'tool_result') then 'drop_' || event_type when event_type = 'git' then 'drop_execution_observation' when agent and blank then 'drop_agent_plumbing' when agent and marker then 'drop_generic_execution_marker'
      when agent and tog then 'keep_agent_coordination' when agent then 'keep_meaningful_progress' when event_type = 'system' then 'drop_system_machinery' when event_type = 'artifact' then case when kind = 'image' and event_id % 2 = 1 then 'keep_human_source' else 'drop_machine_artifact' end
      when blank and not (spoken and event_id % 3 = 0) then 'drop_ambiguous' when marker and who not in ('human', 'speaker', 'user') then 'drop_generic_execution_marker' when event_type = 'reasoning' and record_type = 'thinking' then 'keep_recorded_reasoning' when event_type = 'progress' then 'keep_meaningful_progress'
      when spoken and who in ('human', 'speaker', 'user') then case when interaction = 'correction' then 'keep_human_feedback' else 'keep_human_dialogue' end when spoken and (tog or record_type = 'agent_message') then 'keep_agent_coordination'
      when spoken and who in ('ai', 'assistant') and coalesce(role, '') in ('', 'assistant') then 'keep_agent_dialogue' else 'drop_ambiguous' end as disposition from f""",
    "p6_pseudonyms": "select 'actor-' || sha256(to_json(['conv-' || conv_id, case lower(role) when 'user' then 'human' when 'assistant' then 'ai' else lower(role) end])) as name, 1 as n_actors, count(*) as n_items from conversations group by 1",
    "p7_directions": f"select id, case when payload <> source then 'conflict' when coalesce(payload, source) not in ('a', 'b') then 'not_allowed' else coalesce(payload, source, 'none') end as direction from {dealt_values(DIRECTIONS, 'id', 'payload', 'source')} m",
    "p8_source_ids": "select event_id, case when event_id % 3 <> 0 and event_id % 7 <> 0 and event_id % 5 <> 0 then 'r' || event_id end as record_id from events",
    "p9_contents": "select doc_id, case when doc_id % 2 <> 0 and text <> '' then text[1:20] when doc_id % 3 <> 0 then lang else source end as content from documents",
    "p10_release_items": f"""select 'conv-' || conv_id || ':turn-' || turn as item_id, case when turn % 4 = 3 then 'record' else 'message' end as event_type, case when turn % 4 = 3 then 'participant' else case lower(role) when 'user' then 'human' when 'assistant' then 'ai' else lower(role) end end as actor_type, sha256(text) as content from conversations
      union all select 'event-' || event_id, 'action_label', 'tool', case {_EV} when 'tool_call' then '[tool call]' when 'tool_result' then '[tool result]' when 'system' then '[system action]' when 'artifact' then '[artifact]' else '[action]' end from events""",
    "p13_sequences": "select conv_id, count(*) as n from conversations where conv_id % 5 <> 0 or turn <> 2 group by 1 having min(turn) <> 0 or max(turn) + 1 <> count(*) or count(distinct turn) <> count(*)",
    "p14_corpus_faults": """with r as (select 'conv-' || conv_id as d, conv_id as n, case when conv_id % 17 = 3 and turn = 1 then 'bad id!' else 'conv-' || conv_id || ':turn-' || turn end as i, case when conv_id % 13 = 4 and turn = 2 then 2 else turn + 1 end as s from conversations)
      select 'item_id_invalid' as code, d as id from r where i = 'bad id!' union all select 'item_id_repeated', i from r group by i having count(*) > 1 union all select 'sequence_repeated', d from r group by d, s having count(*) > 1 union all select distinct 'item_count', d from r where n % 11 = 5""",
    "p15_bounded_texts": f"select id, coalesce(trim(text) <> '' and strlen(text) <= 16 and not regexp_matches(text, '[\\x00-\\x1f\\x7f]'), false) as ok from {dealt_values(TEXTS, 'id', 'text')} m",
    "p18_masked_reasons": "select p_partkey, case p_size % 3 when 0 then 'Project event' when 1 then 'Story evidence' else p_type end as reason from part",
    "p19_exact_keys": f"select id, coalesce(list_sort(json_keys(raw)) = ['id', 'text'], false) as exact from {dealt_values(OBJECTS, 'id', 'raw')} m",
    "p21_null_safe": "select nullif(quality, 0) is not distinct from nullif(toxic, 0) as same, count(*) as n from labels group by 1",
    "j2_latest_receipts": "select c_custkey, (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey desc limit 1) as latest from customer",
    "j3_run_items": "select 'run-1' as run, null as item_id union all select 'run-1', 'conv-' || conv_id || ':turn-' || turn from conversations where lower(role) = 'system'",
    "j5_currency": "select o_orderkey as unit, o_orderkey % 6 <> 0 and count(l_orderkey) = max(l_linenumber) as current from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey",
    "j6_span_units": "select l_orderkey as unit, count(*) as n_spans from (select m.l_orderkey from lineitem s join lineitem m on s.l_orderkey = m.l_orderkey and s.l_linenumber = m.l_linenumber where s.l_returnflag = 'R') group by 1",
    "j9_candidates": "with a as (select 'conv-' || conv_id || ':turn-' || (turn + case when conv_id % 4 = 0 then 1 else 0 end - case when conv_id % 9 = 0 and turn > 0 then 1 else 0 end) as item_id, count(*) as n from conversations group by 1), k as (select 'conv-' || conv_id || ':turn-' || turn as item_id, case lower(role) when 'user' then 'human' when 'assistant' then 'ai' else lower(role) end as actor from conversations) select item_id, case when actor is null then 'unknown' when n > 1 then 'repeated' else actor end as found from a left join k using (item_id)",
    "j10_exact_rows": "select o_orderkey as unit, case when o_orderkey % 50 = 1 then 'unknown' when o_orderkey % 50 = 2 then 'missing' else 'repeated' end as code from orders where o_orderkey % 50 in (1, 2) or o_orderkey % 40 = 3",
    "j11_narratives": "select o_custkey, count(*) as n, sha256(string_agg(l_orderkey || ':' || l_linenumber, ',' order by l_orderkey, l_linenumber)) as digest from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'O' group by 1",
    "j17_grounded_claims": f"with c as (select conv_id, case when conv_id % 3 = 0 then turn + 1 else turn end as turn, '  ' || text[5:28] || ' !' as claim from conversations) select c.conv_id, count(*) filter (contains({_CLAIM.format('t.text')}, {_CLAIM.format('claim')})) as n_grounded, count(*) as n_claims from c left join conversations t on t.conv_id = c.conv_id and t.turn = c.turn group by 1",
    "j18_copied_units": "select coalesce(o_orderpriority, 'Unclassified') as category, count(*) as n from lineitem left join (select * from orders where o_orderkey % 3 <> 0) on o_orderkey = l_orderkey group by 1",
    "a4_conservation": "select distinct 'user-' || user_id as document_id, case when user_id % 11 = 0 then 'replays' else 'dropped' end as code from events where user_id % 9 = 0 or user_id % 11 = 0",
    "a10_guards": "select *, orders = customer * 10 as agrees from (select (select count(*) from orders) as orders, (select count(*) from customer) as customer, (select count(*) from labels) as labels)",
    "a15_projects": f"""with i as (select 'conv-' || conv_id as d, 'message' as t, 'conv-' || conv_id || ':turn-' || turn as i from conversations union all select 'user-' || user_id, {_EV}, 'event-' || event_id from events), p as (select 'project-' || length(d) % 4 || '-' || t as project, count(*) as n_events, min(i) as first_item from i group by 1)
      select *, row_number() over (order by n_events desc, project) = 1 as primary_project from p""",
    "a16_document_starts": "select user_id, coalesce(min(case when user_id % 3 <> 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') end), '2024-06-30T00:00:00') as starts from events group by 1",
    "a19_review_summary": "select l_orderkey, count(*) filter (l_linenumber % 3 = 0) as n_delete, count(*) filter (l_linenumber % 3 = 1) as n_revise, count(*) filter (l_linenumber % 3 = 2) as n_add, count(*) filter (l_linestatus = 'O') as n_pending, count(*) filter (l_returnflag = 'R') as n_needs_evidence, count(*) filter (l_linestatus = 'O' or l_returnflag = 'R') as n_unresolved from lineitem group by 1",
    "a21_privacy_totals": """select '{' || string_agg('"' || k || '":' || n, ',' order by k) || '}' as counts, cast(sum(n) as bigint) as total, true as agrees from (select l_returnflag as k, count(*) as n from lineitem group by 1)""",
    "w6_phases": "with p as (select user_id, event_id, cast(floor(day(ts) / 10) as bigint) + case when event_id % 211 = 0 then 1 else 0 end as phase from events), s as (select *, case when lag(phase) over (partition by user_id order by event_id) is distinct from phase then 1 else 0 end as st from p) select user_id, phase, cast(sum(st) as bigint) as islands from s group by 1, 2 having sum(st) > 1",
    "w8_context": "with t as (select *, coalesce(lag(text) over w, '') as b, text || coalesce(lead(text) over w, '') as a, regexp_extract(text, '^\\S*') as word from conversations window w as (partition by conv_id order by turn)) select conv_id, turn, right(b, 20) as left_context, word, substr(a, length(word) + 1, 20) as right_context from t",
    "o5_documents_listing": "select doc_id from documents order by case when doc_id % 6 <> 0 then n_chars end nulls first, source, doc_id limit 50",
    "o10_probe_cap": "select p_partkey, p_brand from (select * from part qualify row_number() over (partition by p_brand order by p_size desc, p_partkey) = 1) order by p_size desc, p_partkey limit 20",
    "o11_longest_first": "select doc_id, length(text) as n from documents order by n desc, doc_id limit 25",
    "u1_known_ids": "select doc_id as id from documents union select doc_id from labels union select page_id from pages",
    "u3_shards": "with s as (select o_custkey + case when o_orderkey % 301 = 0 then 10000000 else 0 end as id, o_custkey % 7 + case when o_orderkey % 400 = 3 then 1 else 0 end as shard from orders where o_orderkey % 3 = 0), p as (select id, count(distinct shard) as n from s group by 1), b as (select coalesce(c_custkey, id) as id, case when c_custkey is null then 'unknown' when n is null then 'missing' when n > 1 then 'overlap' end as code from customer full outer join p on id = c_custkey) select * from b where code is not null",
    "u4_key_sets": "select user_id, string_agg(event_type, ',' order by event_type) as unreported from (select distinct user_id, event_type from events except select user_id, event_type from events where user_id % 5 <> 0 or event_type not in ('error', 'view')) group by 1",
    "u7_merged_units": "select l_orderkey, case when count(distinct case when l_orderkey % 10 = 0 then l_linestatus else 'x' end) = 1 then string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) else 'conflict' end as members from lineitem group by 1",
    "n4_trimmed": "select event_id as id, hex(encode(t)) as trimmed from events join (values (1, 'a'), (2, 'b'), (3, 'c'), (4, chr(8203) || 'd'), (5, ''), (6, 'e' || chr(12288) || 'f')) x(form, t) on form = event_id % 6 + 1",
    "n16_categories": "select regexp_matches(case p_size % 5 when 0 then p_brand || ' API-Key' when 1 then 'PrivateKey' when 2 then 'tokens' else p_type end, 'credential|token|secret|password|api[-_]?key|private[-_]?key', 'i') as credential, count(*) as n from part group by 1",
    "n18_phase_labels": f"select id, label, regexp_matches(label, '^[A-Za-z0-9]+([-''][A-Za-z0-9]+)*(\\s+[A-Za-z0-9]+([-''][A-Za-z0-9]+)*)?$') and lower(label) not in ('project evolution', 'project update', 'workflow progress', 'general work', 'other', 'later stage') as ok from {dealt_values(list(enumerate(PHASES)), 'id', 'label')} m",
    "n20_safe_categories": f"select id, case when regexp_matches(category, '^[a-z0-9][a-z0-9-]{{0,63}}$') then category else 'sensitive' end as category from {dealt_values(list(enumerate(CATEGORY)), 'id', 'category')} m",
    "d3_transcript_days": "select event_id as id, day from events join (values (1, date '2024-02-29'), (2, null), (3, null), (4, date '2024-05-06'), (5, null)) t(form, day) on form = event_id % 5 + 1",
    "d6_stale_leases": "select user_id, coalesce(max(ts) filter (ts <= timestamp '2024-01-15 12:00:00') <= timestamp '2024-01-15 11:30:00', true) as stale from events group by 1",
    "d7_suppressed_clocks": "select user_id, case when count(*) filter (event_type = 'error' and event_id % 19 = 0) > 0 then 0 else count(ts) end as n_clocks from events group by 1",
    "m1_shard_counts": "select source, cast(greatest(1, ceil(sum(strlen(text) + 40) / 20000), ceil(sum(strlen(text)) / 20000), ceil(count(*) / 7)) as bigint) as n_shards from documents group by 1",
    "r1_arrays": "select user_id, array_to_string(list_sort(list(distinct event_type))[1:3], ',') as first_types, count(*) filter (event_type = 'view') as n_views from events group by 1",
    "r2_merged_counters": """select '{' || string_agg('"' || k || '":' || n, ',' order by k) || '}' as counters from (select event_type as k, count(*) as n from events group by 1)""",
}
