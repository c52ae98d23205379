"""Queries over the item model: classification, review coverage, counters, order, identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import classify, relate
from quarry.sources.items import conversation_items, event_items, items, table

ITEMS_SQL = """
conv as (select 'conv-' || conv_id as document_id, turn + 1 as sequence, 'conv-' || conv_id || ':turn-' || turn as item_id, 'message' as event_type,
  case lower(role) when 'user' then 'human' when 'assistant' then 'ai' else lower(role) end as actor_type, lower(role) as role, text as content from conversations),
ev as (select 'user-' || user_id as document_id, event_id as sequence, 'event-' || event_id as item_id,
  case event_type when 'view' then 'tool_call' when 'click' then 'tool_call' when 'error' then 'tool_result' when 'signup' then 'system' when 'purchase' then 'artifact' else event_type end as event_type,
  'tool' as actor_type, cast(null as varchar) as role, props as content from events),
items as (select * from conv union all select * from ev),
classified as (select *, case
  when event_type = 'tool_call' then 'drop_tool_call' when event_type = 'tool_result' then 'drop_tool_result'
  when event_type = 'system' then 'drop_system_machinery' when event_type = 'artifact' then 'drop_machine_artifact'
  when trim(coalesce(content, '')) = '' then 'drop_ambiguous'
  when event_type = 'message' and actor_type = 'human' then 'keep_human_dialogue'
  when event_type = 'message' and actor_type = 'ai' then 'keep_agent_dialogue' else 'drop_ambiguous' end as disposition from items)
"""


def p1_classify(spark, sf_dir):
    found = classify.classified(items(spark, sf_dir))
    return found.select("item_id", "event_type", "actor_type", "disposition", "kept")


def p2_dependent_artifacts(spark, sf_dir):
    found = classify.classified(items(spark, sf_dir))
    number = F.when(F.col("event_type") == "artifact", F.regexp_extract("item_id", r"(\d+)$", 1).cast("long"))
    kind = F.when(number % 2 == 0, "image").when(number.isNotNull(), "archive")
    maker = F.concat(F.lit("conv-"), number % 40, F.lit(":turn-"), number % 5)
    marked = found.withColumns({"kind": kind, "created_by": maker})
    return classify.with_artifacts(marked).filter("event_type = 'artifact'").select("item_id", "disposition", "kept")


def p5_normalized(spark, sf_dir):
    return classify.reviewed(items(spark, sf_dir))


def p11_release_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    system = F.when(F.col("source").isin("src0", "src1", "src2"), F.col("source")).otherwise("local-agent-history")
    return docs.select("doc_id", F.concat(F.lit("document-"), "doc_id").alias("title"), system.alias("source_system"))


def a1_dispositions(spark, sf_dir):
    return classify.classified(items(spark, sf_dir)).groupBy("disposition", "kept").agg(F.count("*").alias("n"))


def a2_event_families(spark, sf_dir):
    found = classify.classified(items(spark, sf_dir))
    return found.groupBy("event_type").agg(F.count("*").alias("raw"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


def a5_coverage_share(spark, sf_dir):
    return classify.coverage_share(items(spark, sf_dir))


def a8_per_document(spark, sf_dir):
    found = conversation_items(spark, sf_dir)
    return found.groupBy("document_id").agg(F.count("*").alias("turns"), F.sum(F.length("content")).cast("long").alias("chars"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


def a11_ordered_json(spark, sf_dir):
    """Turns of each document as one JSON list in order."""
    one = F.struct("sequence", "role")
    return conversation_items(spark, sf_dir).groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("turns"))


def a12_document_digest(spark, sf_dir):
    row = F.struct("sequence", F.sha2(F.concat_ws("\n", "item_id", "role", "content"), 256).alias("d"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["d"])
    return conversation_items(spark, sf_dir).groupBy("document_id").agg(F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("digest"))


def a14_release_counts(spark, sf_dir):
    found = classify.reviewed(items(spark, sf_dir))
    return found.agg(
        F.countDistinct("document_id").alias("documents"), F.count("*").alias("events"),
        F.count_if(F.col("review_type") == "message").alias("conversational"), F.count_if(F.col("review_type") != "message").alias("labels"),
        F.array_join(F.sort_array(F.collect_set("review_type")), ",").alias("types"),
    )


def a20_percent_complete(spark, sf_dir):
    """Kept share of each document in whole percent."""
    found = classify.classified(items(spark, sf_dir)).groupBy("document_id").agg(F.count_if("kept").alias("completed"), F.count("*").alias("total"))
    return found.withColumn("percent", F.floor((F.col("completed") * 200 + F.col("total")) / (F.col("total") * 2)).cast("long"))


def w1_occurrence(spark, sf_dir):
    return relate.occurrence(event_items(spark, sf_dir), ["document_id", "event_type"], ["sequence"]).select("item_id", "nth")


def w3_monotone(spark, sf_dir):
    """Users whose event clock ever runs backwards in the order of their ids."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    back = F.col("ts") < F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return events.withColumn("back", F.coalesce(back, F.lit(False))).groupBy("user_id").agg(F.count_if("back").alias("steps_back"))


def w7_ordinal_ids(spark, sf_dir):
    found = relate.occurrence(event_items(spark, sf_dir), ["document_id"], ["sequence"])
    return found.select("item_id", F.format_string("event-%06d", F.col("nth")).alias("ordinal"))


def w10_neighbours(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("sequence")
    return conversation_items(spark, sf_dir).select("item_id", F.lag("item_id").over(w).alias("before"), F.lead("item_id").over(w).alias("after"))


def w11_byte_cut(spark, sf_dir):
    return relate.page_within(conversation_items(spark, sf_dir), "document_id", ["sequence"], "content", 600).select("item_id", "running_bytes")


def i1_replay_collapse(spark, sf_dir):
    """Documents of equal text are replays of the first; the key is the text's digest."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "lang")
    return relate.collapse_replays(docs, ["digest"], "lang", ["doc_id"]).select("digest", "doc_id", "copies", "conflict")


def i2_projected_ids(spark, sf_dir):
    found = relate.occurrence(event_items(spark, sf_dir), ["document_id", "event_type", "content"], ["sequence"])
    return found.select("item_id", relate.projected_id([F.col("document_id"), F.col("event_type"), F.col("content")], F.col("nth")).alias("projected_id"))


def i5_adjacent_mirrors(spark, sf_dir):
    return relate.adjacent_mirrors(event_items(spark, sf_dir), "document_id", "sequence", ["event_type"]).select("item_id")


def o7_top_documents(spark, sf_dir):
    """The ten documents of the most characters: a top-k report."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars")).orderBy(F.desc("chars"), "doc_id").limit(10)


def o9_page(spark, sf_dir):
    """Third page of twenty conversations' items by total order: paging is the feature."""
    return conversation_items(spark, sf_dir).orderBy("document_id", "sequence", "item_id").offset(40).limit(20).select("item_id")


def u6_concat(spark, sf_dir):
    return items(spark, sf_dir).groupBy(F.substring_index("document_id", "-", 1).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


def j7_most_overlap(spark, sf_dir):
    """For each order's span of days the line of another span table that overlaps it most."""
    days = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), days("o_orderdate").alias("s")).withColumn("e", F.col("s") + 1 + F.col("id") % 9)
    turns = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), (F.lit(700) + F.pmod(F.col("p_partkey") * 37, F.lit(3000))).alias("s")).withColumn("e", F.col("s") + 3 + F.col("label") % 5)
    return relate.most_overlap(spans, turns, 16)


def j8_evidence(spark, sf_dir):
    found = conversation_items(spark, sf_dir)
    refs = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("turn-"), F.col("event_id") % 12)).otherwise(F.concat(F.lit("conv-"), F.floor(F.col("event_id") / 4), F.lit(":turn-"), F.col("event_id") % 4)).alias("ref")).distinct()
    return relate.resolve_evidence(refs, found)


def u2_cover_faults(spark, sf_dir):
    """Lines as members, parts as the universe: a part on several lines is a member of several units."""
    universe = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"))
    return relate.cover_faults(universe, members)


def a17_membership(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("item"), F.col("l_partkey").cast("string").alias("digest"))
    return relate.membership_digest(members, "l_orderkey", "item", "digest")


def h2_revisions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    now = orders.filter("o_orderpriority <> '5-LOW'").select("o_orderkey", F.col("o_orderstatus").alias("digest"))
    was = orders.filter("o_totalprice > 100000").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("digest"), (F.col("o_orderkey") % 4 + 1).alias("revision"))
    return relate.revisions(now, was, "o_orderkey", "digest")


QUERIES = {f.__name__: f for f in (p1_classify, p2_dependent_artifacts, p5_normalized, p11_release_document, a1_dispositions, a2_event_families, a5_coverage_share, a8_per_document, a11_ordered_json, a12_document_digest, a14_release_counts, a17_membership, a20_percent_complete, w1_occurrence, w3_monotone, w7_ordinal_ids, w10_neighbours, w11_byte_cut, i1_replay_collapse, i2_projected_ids, i5_adjacent_mirrors, o7_top_documents, o9_page, u2_cover_faults, u6_concat, j7_most_overlap, j8_evidence, h2_revisions)}

REVIEWED_SQL = ITEMS_SQL + """,
talk as (select *, event_type = 'message' and actor_type in ('human', 'ai') and trim(coalesce(content, '')) <> '' as talks from items),
reviewed as (select document_id, sequence, item_id, case when talks then 'message' else 'action_label' end as review_type,
  case when talks then case actor_type when 'human' then 'user' else 'assistant' end end as speaker,
  case when talks then content when event_type = 'tool_call' then '[tool call]' when event_type = 'tool_result' then '[tool result]' when event_type = 'artifact' then '[artifact]' else '[action]' end as review_text from talk)
"""

ORACLE = {
    "p1_classify": f"with {ITEMS_SQL} select item_id, event_type, actor_type, disposition, disposition like 'keep%' as kept from classified",
    "p2_dependent_artifacts": f"""with {ITEMS_SQL}, a as (select item_id, disposition, cast(regexp_extract(item_id, '(\\d+)$', 1) as bigint) as k from classified where event_type = 'artifact'),
      b as (select a.*, k % 2 = 0 and exists (select 1 from classified c where c.item_id = 'conv-' || (k % 40) || ':turn-' || (k % 5) and c.disposition like 'keep%') as src from a)
      select item_id, case when src then 'keep_human_source' else disposition end as disposition, src as kept from b""",
    "p5_normalized": f"with {REVIEWED_SQL} select * from reviewed",
    "p11_release_document": "select doc_id, 'document-' || doc_id as title, case when source in ('src0', 'src1', 'src2') then source else 'local-agent-history' end as source_system from documents",
    "a1_dispositions": f"with {ITEMS_SQL} select disposition, disposition like 'keep%' as kept, count(*) as n from classified group by 1, 2",
    "a2_event_families": f"with {ITEMS_SQL} select event_type, count(*) as raw, count(*) filter (disposition like 'keep%') as kept, count(*) filter (disposition not like 'keep%') as dropped from classified group by 1",
    "a5_coverage_share": f"with {REVIEWED_SQL} select review_type, count(*) as events, cast(sum(length(review_text)) as bigint) as chars, round(sum(length(review_text)) / sum(sum(length(review_text))) over (), 9) as share, review_type = 'message' as reviewed from reviewed group by 1",
    "a8_per_document": f"with {ITEMS_SQL} select document_id, count(*) as turns, cast(sum(length(content)) as bigint) as chars, cast(sum(strlen(content)) as bigint) as bytes from conv group by 1",
    "a11_ordered_json": f"""with {ITEMS_SQL} select document_id, '[' || string_agg('{{"sequence":' || sequence || ',"role":"' || role || '"}}', ',' order by sequence) || ']' as turns from conv group by 1""",
    "a12_document_digest": f"with {ITEMS_SQL} select document_id, sha256(string_agg(sha256(concat_ws(chr(10), item_id, role, content)), chr(10) order by sequence) || chr(10)) as digest from conv group by 1",
    "a14_release_counts": f"with {REVIEWED_SQL} select count(distinct document_id) as documents, count(*) as events, count(*) filter (review_type = 'message') as conversational, count(*) filter (review_type <> 'message') as labels, string_agg(distinct review_type, ',' order by review_type) as types from reviewed",
    "a17_membership": "select l_orderkey, count(*) as member_count, sha256(string_agg(l_linenumber || ':' || l_partkey, chr(10) order by l_linenumber || ':' || l_partkey)) as membership_digest from lineitem group by 1",
    "a20_percent_complete": f"with {ITEMS_SQL}, t as (select document_id, count(*) filter (disposition like 'keep%') as completed, count(*) as total from classified group by 1) select *, (completed * 200 + total) // (total * 2) as percent from t",
    "w1_occurrence": f"with {ITEMS_SQL} select item_id, row_number() over (partition by document_id, event_type order by sequence) as nth from ev",
    "w3_monotone": "with t as (select user_id, ts < lag(ts) over (partition by user_id order by event_id) as back from events) select user_id, count(*) filter (back) as steps_back from t group by 1",
    "w7_ordinal_ids": f"with {ITEMS_SQL} select item_id, printf('event-%06d', row_number() over (partition by document_id order by sequence)) as ordinal from ev",
    "w10_neighbours": f"with {ITEMS_SQL} select item_id, lag(item_id) over w as \"before\", lead(item_id) over w as \"after\" from conv window w as (partition by document_id order by sequence)",
    "w11_byte_cut": f"with {ITEMS_SQL}, t as (select item_id, cast(sum(strlen(content)) over (partition by document_id order by sequence rows unbounded preceding) as bigint) as running_bytes from conv) select * from t where running_bytes <= 600",
    "i1_replay_collapse": "select sha256(text) as digest, min(doc_id) as doc_id, count(*) as copies, min(lang) <> max(lang) as conflict from documents group by 1",
    "i2_projected_ids": f"with {ITEMS_SQL}, t as (select *, row_number() over (partition by document_id, event_type, content order by sequence) as nth from ev) select item_id, 'evt-' || sha256(concat_ws(chr(10), document_id, event_type, content, nth)) as projected_id from t",
    "i5_adjacent_mirrors": f"with {ITEMS_SQL}, t as (select item_id, event_type, lag(event_type) over (partition by document_id order by sequence) as p from ev) select item_id from t where p is null or p <> event_type",
    "o7_top_documents": "select doc_id, length(text) as chars from documents order by chars desc, doc_id limit 10",
    "o9_page": f"with {ITEMS_SQL} select item_id from conv order by document_id, sequence, item_id limit 20 offset 40",
    "u2_cover_faults": "with m as (select l_partkey as item, count(*) as n from lineitem group by 1), t as (select coalesce(p_partkey, item) as item, case when p_partkey is null then 'unknown' when n is null then 'missing' when n > 1 then 'repeated' end as code from part full outer join m on p_partkey = item) select code, item from t where code is not null",
    "u6_concat": f"with {ITEMS_SQL} select split_part(document_id, '-', 1) as kind, count(*) as n, count(distinct document_id) as documents from items group by 1",
    "j7_most_overlap": """with a as (select o_orderkey as id, date_diff('day', date '1990-01-01', cast(o_orderdate as date)) as s, date_diff('day', date '1990-01-01', cast(o_orderdate as date)) + 1 + o_orderkey % 9 as e from orders),
      b as (select p_partkey as label, 700 + (p_partkey * 37) % 3000 as s, 700 + (p_partkey * 37) % 3000 + 3 + p_partkey % 5 as e from part),
      t as (select id, label, least(a.e, b.e) - greatest(a.s, b.s) as overlap, row_number() over (partition by id order by least(a.e, b.e) - greatest(a.s, b.s) desc, b.s, label desc) as k from a join b on a.s < b.e and b.s < a.e)
      select id, label, overlap from t where k = 1""",
    "j8_evidence": f"""with {ITEMS_SQL}, r as (select distinct case when event_id % 3 = 0 then 'turn-' || (event_id % 12) else 'conv-' || (event_id // 4) || ':turn-' || (event_id % 4) end as ref from events),
      tails as (select split_part(item_id, ':', -1) as tail, count(*) as n, min(item_id) as one from conv group by 1),
      t as (select ref, case when c.item_id is not null then 'exact' when n = 1 then 'suffix' when n > 1 then 'ambiguous' else 'missing' end as state, c.item_id, one from r left join conv c on c.item_id = ref left join tails on tail = ref)
      select ref, state, case state when 'exact' then item_id when 'suffix' then one end as item_id from t""",
    "h2_revisions": """with n as (select o_orderkey, o_orderstatus as d from orders where o_orderpriority <> '5-LOW'),
      w as (select o_orderkey, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as d, o_orderkey % 4 + 1 as r from orders where o_totalprice > 100000),
      t as (select coalesce(n.o_orderkey, w.o_orderkey) as o_orderkey, case when n.d is null then 'removed' when w.d is null then 'added' when n.d = w.d then 'same' else 'changed' end as change, r from n full outer join w on n.o_orderkey = w.o_orderkey)
      select o_orderkey, change, case change when 'added' then 1 when 'changed' then r + 1 else r end as revision from t""",
}
