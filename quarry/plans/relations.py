"""Relational queries: lookups, covers, history and coverage over orders (units), lines (members) and customers (owners)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import classify, relate
from quarry.sources.items import conversation_items, event_items, items, table


def j1_item_document(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    found = lines.select("l_orderkey", "l_linenumber").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey", "left")
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def j12_changes(spark, sf_dir):
    """Rows changed, added or removed between two states, with both digests."""
    parts = table(spark, sf_dir, "part")
    now = parts.filter("p_size > 8").select("p_partkey", F.sha2("p_name", 256).alias("digest"))
    was = parts.filter("p_retailprice > 950").select("p_partkey", F.sha2(F.when(F.col("p_partkey") % 9 == 0, "old").otherwise(F.col("p_name")), 256).alias("digest"))
    both = now.withColumnRenamed("digest", "new").join(was.withColumnRenamed("digest", "old"), "p_partkey", "full_outer")
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").otherwise("changed")
    return both.filter(~F.col("new").eqNullSafe(F.col("old"))).select("p_partkey", change.alias("change"), "old", "new")


def j13_semi(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


def j14_anti(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(asked, "c_custkey", "left_anti").select("c_custkey")


def w2_resequenced(spark, sf_dir):
    kept = event_items(spark, sf_dir).filter("event_type <> 'tool_call'")
    return relate.occurrence(kept, ["document_id"], ["sequence"]).select("item_id", F.col("nth").alias("sequence"))


def w9_latest(spark, sf_dir):
    """Latest order of each customer, the larger key among equal dates."""
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("x")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(last).select("o_custkey", F.col("x.o_orderkey").alias("o_orderkey"), F.col("x.o_orderstatus").alias("o_orderstatus"))


def w12_first_wins(spark, sf_dir):
    """First event of each user and type, and how many later ones it stands for."""
    first = F.min(F.struct("sequence", "item_id")).alias("x")
    found = event_items(spark, sf_dir).groupBy("document_id", "event_type").agg(first, F.count("*").alias("n"))
    return found.select("document_id", "event_type", F.col("x.item_id").alias("item_id"), (F.col("n") - 1).alias("duplicates"))


def a3_rollup(spark, sf_dir):
    """Counters of each document summed over the run, by disposition and in all."""
    found = classify.classified(items(spark, sf_dir)).groupBy("document_id", "disposition").agg(F.count("*").alias("n"))
    return found.rollup("disposition").agg(F.sum("n").alias("n"), F.countDistinct("document_id").alias("documents")).select(F.coalesce("disposition", F.lit("all")).alias("disposition"), "n", "documents")


def a18_date_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("day", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("date")))
    return orders.groupBy("o_custkey").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.bool_or(F.col("day").isNull()).alias("some_unknown"))


def h8_coverage(spark, sf_dir):
    """Each unit's coverage row, judged: represented units need an owner, excluded ones an allowed reason."""
    orders = table(spark, sf_dir, "orders")
    represented = F.col("o_orderstatus") == "O"
    owner = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))
    reason = F.substring("o_orderpriority", 1, 1)
    code = F.when(represented & owner.isNull(), "missing_owner").when(~represented & ~reason.isin("1", "2", "3"), "reason_not_allowed")
    return orders.select("o_orderkey", code.alias("code")).filter("code is not null")


def g17_authorised_units(spark, sf_dir):
    """Conversations with a turn that a decision redacts, by a join of decisions to turns."""
    turns = conversation_items(spark, sf_dir).select("document_id", F.regexp_extract("document_id", r"(\d+)", 1).cast("long").alias("doc_id"))
    redact = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return turns.join(redact, "doc_id", "left_semi").select("document_id").distinct()


def o1_timeline(spark, sf_dir):
    """First fifty events of the timeline: a top-k report; unknown clocks come first."""
    events = table(spark, sf_dir, "events").withColumn("at", F.when(F.col("event_id") % 97 != 0, F.col("ts")))
    tag = F.col("at").isNotNull().cast("int")
    return events.orderBy(tag, "at", "user_id", "event_id").limit(50).select("event_id")


def u5_subset(spark, sf_dir):
    """Customers whose orders' states are all among those allowed."""
    states = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return states.select("o_custkey", (F.size(F.array_except("s", F.array(F.lit("O"), F.lit("F")))) == 0).alias("within"))


QUERIES = {f.__name__: f for f in (j1_item_document, j12_changes, j13_semi, j14_anti, w2_resequenced, w9_latest, w12_first_wins, a3_rollup, a18_date_range, h8_coverage, g17_authorised_units, o1_timeline, u5_subset)}

_KIND = "case event_type when 'view' then 'tool_call' when 'click' then 'tool_call' when 'error' then 'tool_result' when 'signup' then 'system' when 'purchase' then 'artifact' else event_type end"
ORACLE = {
    "j1_item_document": "select o_orderstatus, count(*) as n from lineitem left join orders on o_orderkey = l_orderkey group by 1",
    "j12_changes": """with n as (select p_partkey, sha256(p_name) as d from part where p_size > 8), w as (select p_partkey, sha256(case when p_partkey % 9 = 0 then 'old' else p_name end) as d from part where p_retailprice > 950)
      select coalesce(n.p_partkey, w.p_partkey) as p_partkey, case when n.d is null then 'removed' when w.d is null then 'added' else 'changed' end as change, w.d as old, n.d as new from n full outer join w on n.p_partkey = w.p_partkey where n.d is distinct from w.d""",
    "j13_semi": "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)",
    "j14_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)",
    "w2_resequenced": "select 'event-' || event_id as item_id, row_number() over (partition by user_id order by event_id) as sequence from events where event_type not in ('view', 'click')",
    "w9_latest": "select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "w12_first_wins": f"select 'user-' || user_id as document_id, {_KIND} as event_type, 'event-' || min(event_id) as item_id, count(*) - 1 as duplicates from events group by 1, 2",
    "a3_rollup": f"""with i as (select 'conv-' || conv_id as d, case when trim(coalesce(text, '')) = '' or lower(role) not in ('user', 'assistant') then 'drop_ambiguous' when lower(role) = 'user' then 'keep_human_dialogue' else 'keep_agent_dialogue' end as disposition from conversations
      union all select 'user-' || user_id, case {_KIND} when 'tool_call' then 'drop_tool_call' when 'tool_result' then 'drop_tool_result' when 'system' then 'drop_system_machinery' else 'drop_machine_artifact' end from events)
      select coalesce(disposition, 'all') as disposition, count(*) as n, count(distinct d) as documents from i group by rollup (disposition)""",
    "a18_date_range": "with t as (select o_custkey, case when o_orderkey % 10 <> 0 then cast(o_orderdate as date) end as day from orders) select o_custkey, min(day) as first_day, max(day) as last_day, bool_or(day is null) as some_unknown from t group by 1",
    "h8_coverage": "with t as (select o_orderkey, case when o_orderstatus = 'O' and o_custkey % 5 = 0 then 'missing_owner' when o_orderstatus <> 'O' and substr(o_orderpriority, 1, 1) not in ('1', '2', '3') then 'reason_not_allowed' end as code from orders) select * from t where code is not null",
    "g17_authorised_units": "select distinct 'conv-' || conv_id as document_id from conversations where conv_id in (select doc_id from labels where toxic = 1)",
    "o1_timeline": "select event_id from (select *, case when event_id % 97 <> 0 then ts end as clock from events) order by (clock is not null), clock, user_id, event_id limit 50",
    "u5_subset": "select o_custkey, bool_and(o_orderstatus in ('O', 'F')) as within from orders group by 1",
}
