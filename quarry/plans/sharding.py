"""Queries that deal records to shards and bins. Customers stand for projects, the lines of their orders for contributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import shards
from quarry.sources.items import table

#: Bytes of a shard, and of what surrounds its records.
SHARD, ENVELOPE = 4_000, 300


def contributions(spark, sf_dir):
    """Lines by customer: id, bytes, content_bytes. Every line with a discount of 9 % of a part whose number ends in 77 is too large for a shard."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    content = 20 + F.col("l_partkey") % 97 + 10 * F.col("l_linenumber")
    large = (F.round(F.col("l_discount") * 100) == 9) & (F.col("l_partkey") % 100 == 77)
    rows = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey")
    return rows.select(
        F.col("o_custkey").alias("project"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("id"),
        (content + 100 + F.when(large, 5_000).otherwise(F.col("l_suppkey") % 50)).alias("bytes"), content.alias("content_bytes"),
    )


def told(found):
    return found.select(F.col("group").cast("long").alias("project"), "id", "shard", "place", "error")


def h4_semantic_shards(spark, sf_dir):
    """As few balanced shards as keep their bytes within bounds, for each project."""
    return told(shards.semantic_shards(contributions(spark, sf_dir), "project", SHARD, ENVELOPE))


def h6_balanced_groups(spark, sf_dir):
    """Each project's contributions cut to parts of about 3000 bytes and 15 records."""
    return told(shards.balanced_groups(contributions(spark, sf_dir), "project", 15, 3_000))


def h5_bins(spark, sf_dir):
    """Each project's contributions in bins of at most 1000 bytes and 5 records, first fit."""
    return told(shards.bins(contributions(spark, sf_dir), "project", 1_000, 5))


_RECORDS = """
rec as (select o_custkey as project, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int) as id, (20 + l_partkey % 97 + 10 * l_linenumber)::bigint as c,
  (120 + l_partkey % 97 + 10 * l_linenumber + case when round(l_discount * 100) = 9 and l_partkey % 100 = 77 then 5000 else l_suppkey % 50 end)::bigint as b from lineitem join orders on o_orderkey = l_orderkey),
"""

_PLACE = """
fold(project, k, i, b, c, n, put) as (
  select project, k, 0, list_transform(range(k), lambda x: 0::bigint), list_transform(range(k), lambda x: 0::bigint), list_transform(range(k), lambda x: 0::bigint), []::bigint[] from tries
  union all
  select f.project, f.k, f.i + 1, list_transform(f.b, lambda x, j: x + case when j = w.p then s.b else 0 end), list_transform(f.c, lambda x, j: x + case when j = w.p then s.c else 0 end), list_transform(f.n, lambda x, j: x + case when j = w.p then 1 else 0 end), list_append(f.put, w.p)
  from fold f join seq s on s.project = f.project and s.i = f.i + 1,
  lateral (select list_sort(list_transform(range(1, f.k + 1), lambda j: {'b': f.b[j], 'c': f.c[j], 'n': f.n[j], 'j': j}))[1].j as p) w)
"""

H4_SQL = (
    "with recursive"
    + _RECORDS
    + """bad as (select distinct project from rec where b > 4000),
seq as (select *, row_number() over (partition by project order by b desc, c desc, id) as i from rec where project not in (select project from bad)),
tot as (select project, greatest(1, ceil(sum(b) / 4000), ceil(sum(c) / 4000), ceil(count(*) / 512))::bigint as k, count(*) as n from seq group by 1),
-- all numbers of shards that may be wanted, beside one another
tries as (select project, k + x as k from tot, range(6) r(x) where k + x <= n),"""
    + _PLACE
    + """, done as (select f.project, f.k, f.put from fold f join tot on tot.project = f.project and f.i = tot.n where list_max(list_transform(f.b, lambda x, j: x + f.n[j] - 1 + 300)) <= 4000),
won as (select project, arg_min(put, k) as put from done group by 1)
select s.project, s.id, (w.put[s.i] - 1)::int as shard, (row_number() over (partition by s.project, w.put[s.i] order by s.id) - 1)::int as place, null as error from seq s join won w using (project)
union all select project, id, null, null, 'record_too_large' from rec where b > 4000
union all select project, null, null, null, 'envelope_too_large' from tot where project not in (select project from won)
"""
)

H6_SQL = (
    "with recursive"
    + _RECORDS.replace(" as c,", " as c0,").replace("from lineitem", ", 0::bigint as c from lineitem")
    + """seq as (select *, row_number() over (partition by project order by b desc, id) as i from rec),
tries as (select project, least(count(*), greatest(1, ceil(count(*) / 15), ceil(sum(b) / 3000)))::bigint as k from seq group by 1),"""
    + _PLACE
    + """, won as (select project, arg_max(put, i) as put from fold group by 1)
select s.project, s.id, (w.put[s.i] - 1)::int as shard, (row_number() over (partition by s.project, w.put[s.i] order by s.id) - 1)::int as place, null::varchar as error from seq s join won w using (project)
"""
)

H5_SQL = (
    "with recursive"
    + _RECORDS
    + """seq as (select *, row_number() over (partition by project order by b desc, id) as i from rec),
fold(project, i, b, n, put) as (
  select distinct project, 0, []::bigint[], []::bigint[], []::bigint[] from seq
  union all
  select f.project, f.i + 1, list_transform(f.b || case when w.p > len(f.b) then [0::bigint] else [] end, lambda x, j: x + case when j = w.p then s.b else 0 end),
    list_transform(f.n || case when w.p > len(f.n) then [0::bigint] else [] end, lambda x, j: x + case when j = w.p then 1 else 0 end), list_append(f.put, w.p)
  from fold f join seq s on s.project = f.project and s.i = f.i + 1,
  lateral (select coalesce(list_min(list_filter(range(1, len(f.b) + 1), lambda j: f.n[j] < 5 and f.b[j] + s.b <= 1000)), len(f.b) + 1) as p) w),
won as (select project, arg_max(put, i) as put from fold group by 1)
select s.project, s.id, (w.put[s.i] - 1)::int as shard, (row_number() over (partition by s.project, w.put[s.i] order by s.id) - 1)::int as place, null::varchar as error from seq s join won w using (project)
"""
)

QUERIES = {"h4_semantic_shards": h4_semantic_shards, "h6_balanced_groups": h6_balanced_groups, "h5_bins": h5_bins}
ORACLE = {"h4_semantic_shards": H4_SQL, "h6_balanced_groups": H6_SQL, "h5_bins": H5_SQL}
