"""Queries over what one step hands to the next: receipts, scopes, bundles, choices, presentations and sessions.

Orders stand for chapters and units, customers for owners and runs, lines for members and attempts, parts for questions.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import records as rec
from quarry.plans.evidence import dealt, dealt_values
from quarry.sources.items import conversation_items, table


def g15_publishable(spark, sf_dir):
    """Occurrences that may be published, and those that are: credentials never, others if a contributor said so."""
    kind = F.when(F.col("l_linenumber") == 1, "credential").otherwise("name")
    can = (kind != "credential") & (F.col("l_returnflag") != "R")
    return table(spark, sf_dir, "lineitem").groupBy(can.alias("can_publish"), (can & (F.col("l_linestatus") == "O")).alias("is_public")).agg(F.count("*").alias("n"))


def l7_proposal_states(spark, sf_dir):
    """Where each chapter's proposals stand: a refused one may be corrected twice, then no more."""
    tries = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("taken"), F.count_if(F.col("l_returnflag") == "R").alias("refused"))
    state = F.when(F.col("taken"), "accepted").when(F.col("refused") == 0, "awaiting").when(F.col("refused") <= 2, "correctable").otherwise("exhausted")
    return tries.select("l_orderkey", state.alias("state"))


def x2_handoff(spark, sf_dir):
    """Runs that are handed on: all chapters confirmed, and the release too."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") != "P").alias("confirmed"))
    return per.select("o_custkey", "confirmed", "total", ((F.col("confirmed") == F.col("total")) & (F.col("o_custkey") % 3 != 0)).alias("handed_on"))


def f4_bulk_faults(spark, sf_dir):
    """Bulk decisions with a fault: no kind, a negative count, a sample that repeats, or evidence that is not known."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 19 != 0, F.col("o_orderpriority")).otherwise("").alias("kind"), (k % 23 - 1).alias("count"))
    sample = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("l_partkey").alias("n"), F.countDistinct("l_partkey").alias("d"), F.max("l_partkey").alias("top"))
    known = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("last")).select((F.col("last") - 3).alias("last"))
    rows = orders.join(sample, "id", "left").join(F.broadcast(known), F.lit(True))
    code = F.when(F.trim("kind") == "", "kind").when(F.col("count") < 0, "count").when(F.col("n") != F.col("d"), "repeated").when(F.col("top") > F.col("last"), "foreign")
    return rows.select("id", code.alias("code")).filter("code is not null")


def f6_lesson_context(spark, sf_dir):
    """Lessons with the reviewed evidence that they cite, each item once in the order first cited."""
    cited = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), "l_linenumber").groupBy("l_orderkey", "item").agg(F.min("l_linenumber").alias("at"))
    reviewed = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("item"))
    packed = cited.join(reviewed, "item", "left_semi").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("all"))
    return packed.select("l_orderkey", F.array_join(F.transform("all", lambda x: x["item"]).cast("array<string>"), ",").alias("items"))


def t9_lane_receipts(spark, sf_dir):
    """One receipt for each lane: what came in, what went out, and how many. A lane's digest is that of the digests of a thousand numbers each, in order."""
    key = F.col("o_orderkey")
    some = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("lane"), F.floor(key / 1_000).alias("block")).agg(F.count("*").alias("n_in"), F.count_if(F.col("o_orderstatus") == "F").alias("n_out"), F.sha2(F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), ","), 256).alias("digest"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"])
    return some.groupBy("lane").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.sha2(F.array_join(ordered, ","), 256).alias("input_digest"))


def t10_release_chapters(spark, sf_dir):
    """Confirmed chapters with their accepted insights nested in them, in order; chapters without one too."""
    chapters = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    insights = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), F.struct(F.col("l_linenumber").alias("insight"), F.col("l_partkey").alias("part")).alias("x"))
    packed = chapters.join(insights, "o_orderkey", "left").groupBy("o_orderkey").agg(F.array_sort(F.collect_list("x")).alias("all"))
    return packed.select("o_orderkey", F.to_json("all").alias("insights"))


def v2_evidence_split(spark, sf_dir):
    """The same rows twice: clocks and places without text, and texts without clocks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    meta = rows.select(F.lit("meta").alias("part"), "conv_id", "turn", F.lit(None).cast("string").alias("body"))
    return meta.unionByName(rows.select(F.lit("text").alias("part"), "conv_id", F.lit(None).cast("bigint").alias("turn"), F.sha2("text", 256).alias("body")))


def v3_scoped_units(spark, sf_dir):
    """Units of a wanted list with their members; whether all of the list are there."""
    wanted = table(spark, sf_dir, "orders").filter("o_orderkey % 9 = 0").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 81 == 0, 100_000_000).otherwise(0)).alias("l_orderkey"))
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return wanted.join(held, "l_orderkey", "left").agg(F.count("n").alias("n_units"), F.sum("n").alias("n_members"), F.count_if(F.col("n").isNull()).alias("n_missing"))


def v12_mapping_faults(spark, sf_dir):
    """Proposed mappings of a shard: members not assigned to it, and assigned ones that no unit has."""
    assigned = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10).alias("shard"))
    mapped = table(spark, sf_dir, "lineitem").filter("l_quantity < 30").select(F.col("l_partkey").alias("id"), (F.col("l_partkey") % 10 + F.when(F.col("l_partkey") % 53 == 0, 1).otherwise(0)).alias("shard")).distinct()
    both = assigned.withColumn("a", F.lit(True)).join(mapped.withColumn("m", F.lit(True)), ["id", "shard"], "full_outer")
    return both.filter("a is null or m is null").select("id", "shard", F.when(F.col("a").isNull(), "not_assigned").otherwise("not_mapped").alias("code"))


def v17_owner_bundles(spark, sf_dir):
    """Bundled units that another owner represents, or no one."""
    bundle = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 45 == 0, 1).otherwise(0)).alias("owner"))
    real = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_custkey").alias("real"))
    both = bundle.join(real, "o_orderkey", "left").filter("real is null or real <> owner")
    return both.select("o_orderkey", F.when(F.col("real").isNull(), "not_represented").otherwise("other_owner").alias("code"))


KEYS = [(1, '{"title":"a","source_path":"x"}'), (2, '{"Title":"a"}'), (3, '{"Source-Path":1,"z":2}'), (4, '{"rawText":1}'), (5, '{}'), (6, '{"raw_text_":0,"ok":1}')]


def v20_forbidden_keys(spark, sf_dir):
    """Objects with a key that may not be there, however it is written."""
    plain = F.transform(F.json_object_keys("raw"), lambda k: F.lower(F.regexp_replace(k, "[^A-Za-z0-9]", "")))
    return dealt(spark, sf_dir, KEYS, "id int, raw string").select("id", F.exists(plain, lambda k: k.isin("sourcepath", "rawtext")).alias("forbidden"))


def v24_language_rows(spark, sf_dir):
    """Language rows of the wanted keys; those without a row are told."""
    policy = table(spark, sf_dir, "documents").filter("doc_id % 8 <> 3").select("doc_id", "lang")
    wanted = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return wanted.join(policy, "doc_id", "left").groupBy(F.coalesce("lang", F.lit("missing")).alias("lang")).agg(F.count("*").alias("n"))


def v27_retained_choices(spark, sf_dir):
    """Targets whose stored choice is kept, as their content is the same; others have to be prepared."""
    now = table(spark, sf_dir, "part").select("p_partkey", F.sha2("p_name", 256).alias("digest"))
    stored = table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select("p_partkey", F.sha2(F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")), 256).alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("digest"), "kept").otherwise("changed")
    return now.join(stored, "p_partkey", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def v35_stale_questions(spark, sf_dir):
    """Questions to be asked anew, with the kinds of evidence behind each."""
    stale = table(spark, sf_dir, "part").filter("p_size % 7 = 0").select(F.col("p_partkey").alias("l_partkey"))
    kinds = table(spark, sf_dir, "lineitem").join(stale, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("k"))
    return stale.join(kinds, "l_partkey", "left").select("l_partkey", F.coalesce(F.array_join("k", ","), F.lit("")).alias("kinds"))


SHOWN = [(1, "en", "a,b", "Hi"), (1, "zh", "a,b", "你好"), (2, "en", "a,b", "Hi"), (3, "zh", "a", "一"), (3, "en", "a,c", "One")]


def v37_presentations(spark, sf_dir):
    """The Chinese form of each question, if its options are those of the question; no other form in its stead."""
    rows, want = dealt(spark, sf_dir, SHOWN, "id int, lang string, options string, text string"), F.when(F.col("form") == 3, "a,c").otherwise("a,b")
    fits = (F.col("lang") == "zh") & (F.col("options") == want)
    return rows.groupBy("id").agg(F.max(F.when(fits, F.col("text"))).alias("text"))


def v39_kind_labels(spark, sf_dir):
    labels = F.create_map(*[F.lit(x) for kv in (("BUILDING", "build"), ("MACHINERY", "machine"), ("HOUSEHOLD", "home")) for x in kv])
    return table(spark, sf_dir, "customer").groupBy(F.coalesce(F.try_element_at(labels, F.col("c_mktsegment")), F.lit("other")).alias("label")).agg(F.count("*").alias("n"))


def v49_support_items(spark, sf_dir):
    """Items that support something, each once; the text is fetched for these only."""
    cited = table(spark, sf_dir, "events").select(F.concat(F.lit("conv-"), F.floor(F.col("event_id") / 9), F.lit(":turn-"), F.col("event_id") % 9).alias("item_id")).distinct()
    return conversation_items(spark, sf_dir).join(cited, "item_id", "left_semi").select("item_id", F.length("content").cast("long").alias("chars"))


def v50_session_heads(spark, sf_dir):
    """Files whose first system line has all that names a session."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("head"))
    files = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return files.join(rows, "conv_id", "left").select("conv_id", F.coalesce(F.length("head") > 20, F.lit(False)).alias("named"))


def v51_selected_sessions(spark, sf_dir):
    """Sessions of the default store by their folder, of an explicit root all."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "default").otherwise("explicit").alias("root"), (F.col("event_id") % 5 == 0).alias("inside"))
    return rows.filter((F.col("root") == "explicit") | F.col("inside")).groupBy("root").agg(F.count("*").alias("n"))


def v91_receipt_chain(spark, sf_dir):
    """Breaks in a chain of receipts: each lane's input must be the output of the one before."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    out = F.sha2(F.col("p").cast("string"), 256)
    rows = rows.withColumn("out", out).withColumn("prev", F.lag("out").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    told = F.when(F.col("p") % 37 == 0, F.lit("stale")).otherwise(F.col("prev"))
    return rows.filter("prev is not null").withColumn("told", told).filter("told <> prev").select("l_orderkey", "l_linenumber")


QUERIES = {f.__name__: f for f in (
    g15_publishable, l7_proposal_states, x2_handoff, f4_bulk_faults, f6_lesson_context, t9_lane_receipts, t10_release_chapters, v2_evidence_split, v3_scoped_units, v12_mapping_faults, v17_owner_bundles,
    v20_forbidden_keys, v24_language_rows, v27_retained_choices, v35_stale_questions, v37_presentations, v39_kind_labels, v49_support_items, v50_session_heads, v51_selected_sessions, v91_receipt_chain,
)}

ORACLE = {
    "g15_publishable": "select l_linenumber <> 1 and l_returnflag <> 'R' as can_publish, l_linenumber <> 1 and l_returnflag <> 'R' and l_linestatus = 'O' as is_public, count(*) as n from lineitem group by 1, 2",
    "l7_proposal_states": "select l_orderkey, case when bool_or(l_returnflag = 'A') then 'accepted' when count(*) filter (l_returnflag = 'R') = 0 then 'awaiting' when count(*) filter (l_returnflag = 'R') <= 2 then 'correctable' else 'exhausted' end as state from lineitem group by 1",
    "x2_handoff": "select o_custkey, count(*) filter (o_orderstatus <> 'P') as confirmed, count(*) as total, count(*) filter (o_orderstatus = 'P') = 0 and o_custkey % 3 <> 0 as handed_on from orders group by o_custkey",
    "f4_bulk_faults": "with s as (select l_orderkey, count(l_partkey) as n, count(distinct l_partkey) as d, max(l_partkey) as top from lineitem group by 1), c as (select o_orderkey as id, case when o_orderkey % 19 = 0 then 'kind' when o_orderkey % 23 = 0 then 'count' when n <> d then 'repeated' when top > (select max(p_partkey) - 3 from part) then 'foreign' end as code from orders left join s on l_orderkey = o_orderkey) select * from c where code is not null",
    "f6_lesson_context": "with c as (select l_orderkey, l_partkey as item, min(l_linenumber) as at_line from lineitem where l_partkey in (select p_partkey from part where p_size > 10) group by 1, 2) select l_orderkey, string_agg(item::varchar, ',' order by at_line, item) as items from c group by 1",
    "t9_lane_receipts": "with b as (select o_orderpriority as lane, o_orderkey // 1000 as b, count(*) as n, count(*) filter (o_orderstatus = 'F') as f, sha256(string_agg(o_orderkey::varchar, ',' order by o_orderkey)) as d from orders group by 1, 2) select lane, sum(n)::bigint as n_in, sum(f)::bigint as n_out, sha256(string_agg(d, ',' order by b)) as input_digest from b group by 1",
    "t10_release_chapters": """select o_orderkey, '[' || coalesce(string_agg('{"insight":' || l_linenumber || ',"part":' || l_partkey || '}', ',' order by l_linenumber, l_partkey), '') || ']' as insights from orders left join (select * from lineitem where l_returnflag = 'A') on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1""",
    "v2_evidence_split": "select 'meta' as part, conv_id, turn, null::varchar as body from conversations union all select 'text', conv_id, null, sha256(text) from conversations",
    "v3_scoped_units": "with w as (select o_orderkey + case when o_orderkey % 81 = 0 then 100000000 else 0 end as k from orders where o_orderkey % 9 = 0), h as (select l_orderkey, count(*) as n from lineitem group by 1) select count(n) as n_units, cast(sum(n) as bigint) as n_members, count(*) - count(n) as n_missing from w left join h on l_orderkey = k",
    "v12_mapping_faults": "with a as (select p_partkey as id, p_partkey % 10 as shard from part), m as (select distinct l_partkey as id, l_partkey % 10 + case when l_partkey % 53 = 0 then 1 else 0 end as shard from lineitem where l_quantity < 30) select coalesce(a.id, m.id) as id, coalesce(a.shard, m.shard) as shard, case when a.id is null then 'not_assigned' else 'not_mapped' end as code from a full outer join m on a.id = m.id and a.shard = m.shard where a.id is null or m.id is null",
    "v17_owner_bundles": "select o_orderkey, case when o_orderstatus = 'P' then 'not_represented' else 'other_owner' end as code from orders where o_orderstatus = 'P' or o_orderkey % 45 = 0",
    "v20_forbidden_keys": f"select id, len(list_filter(json_keys(raw), lambda k: lower(regexp_replace(k, '[^A-Za-z0-9]', '', 'g')) in ('sourcepath', 'rawtext'))) > 0 as forbidden from {dealt_values(KEYS, 'id', 'raw')} m",
    "v24_language_rows": "select coalesce(lang, 'missing') as lang, count(*) as n from (select distinct doc_id from labels) left join (select * from documents where doc_id % 8 <> 3) using (doc_id) group by 1",
    "v27_retained_choices": "select case when p_partkey % 5 = 0 then 'new' when p_partkey % 4 = 0 then 'changed' else 'kept' end as state, count(*) as n from part group by 1",
    "v35_stale_questions": "select p_partkey as l_partkey, coalesce(string_agg(distinct l_returnflag, ',' order by l_returnflag), '') as kinds from part left join lineitem on l_partkey = p_partkey where p_size % 7 = 0 group by 1",
    "v37_presentations": f"select id, max(case when lang = 'zh' and options = case when form = 3 then 'a,c' else 'a,b' end then text end) as text from {dealt_values(SHOWN, 'id', 'lang', 'options', 'text')} m group by 1",
    "v39_kind_labels": "select case c_mktsegment when 'BUILDING' then 'build' when 'MACHINERY' then 'machine' when 'HOUSEHOLD' then 'home' else 'other' end as label, count(*) as n from customer group by 1",
    "v49_support_items": "select 'conv-' || conv_id || ':turn-' || turn as item_id, length(text) as chars from conversations where (conv_id, turn) in (select (event_id // 9, event_id % 9) from events)",
    "v50_session_heads": "select conv_id, coalesce(length(arg_min(text, turn) filter (role = 'system')) > 20, false) as named from conversations group by 1",
    "v51_selected_sessions": "select case when user_id % 2 = 0 then 'default' else 'explicit' end as root, count(*) as n from events where user_id % 2 <> 0 or event_id % 5 = 0 group by 1",
    "v91_receipt_chain": "with r as (select l_orderkey, l_linenumber, min(l_partkey) as p from lineitem group by 1, 2) select l_orderkey, l_linenumber from r where p % 37 = 0 and exists (select 1 from r b where b.l_orderkey = r.l_orderkey and b.l_linenumber < r.l_linenumber)",
}
