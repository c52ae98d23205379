"""Queries over edits: splices between turns, ledgers of edited chapters, their revisions and faults.

Orders stand for chapters of two blocks, their lines for edits, notes and actions.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import diff
from quarry.operators import ledger
from quarry.sources.items import table


def n14_splices(spark, sf_dir):
    """What turns each turn's text into the next one of its conversation."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next is not null")
    found = pairs.select("conv_id", "turn", diff.splice(F.col("text"), F.col("next")).alias("x"))
    return found.select("conv_id", "turn", F.col("x.start").alias("start_at"), F.col("x.end").alias("end_at"), F.sha2("x.inserted", 256).alias("inserted_sha256"))


N14_SQL = """
with p as (select conv_id, turn, text as a, lead(text) over (partition by conv_id order by turn) as b from conversations),
h as (select *, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))), 0) as head from p where b is not null),
t as (select *, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) - head + 1), lambda i: right(a, i) = right(b, i))), 0) as tail from h)
select conv_id, turn, case when a <> b then head end::int as start_at, case when a <> b then length(a) - tail end::int as end_at,
  case when a <> b then sha256(substr(b, head + 1, length(b) - tail - head)) end as inserted_sha256 from t
"""


def block_text(key, block):
    return F.concat(F.lit("Order "), key, F.lit(" "), block, F.lit(" of customer "), F.col("o_custkey"), F.lit(": "), F.col("o_orderpriority"))


def chapter_blocks(spark, sf_dir):
    """Two blocks for each order, one in each language."""
    key = F.col("o_orderkey")
    text = lambda name: block_text(key, F.lit(name))
    orders = table(spark, sf_dir, "orders")
    one = lambda block, language: orders.select(key.alias("chapter"), F.lit(block).alias("block"), F.lit(language).alias("language"), text(block).alias("text"))
    return one("a", "en").unionByName(one("b", "zh"))


def numbered_lines(spark, sf_dir):
    """Lines with their place n in the order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))


def chapter_changes(spark, sf_dir, planted=True):
    """Applied edits and notes: lines 1 to 4 make revision 2, 5 to 7 revision 3, each further one a revision.

    Planted: every 7th chapter has notes in block b, every 23rd does not meet its text in revision
    2, every 29th has two edits that conflict.
    """
    key, n = F.col("chapter"), F.col("n")
    block = F.when(n % 2 == 1, "a").otherwise("b")
    # lines are numbered by chapter and meet their order by it alone: its row gives the text of either block
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chapter"), "o_custkey", "o_orderpriority")
    language = F.when(block == "a", "en").otherwise("zh")
    rows = numbered_lines(spark, sf_dir).withColumnRenamed("l_orderkey", "chapter").join(orders, "chapter").withColumns({"block": block, "language": language, "text": block_text(key, block)})
    every = lambda k: (key % k == 0) & F.lit(planted)
    note = every(7) & n.isin(2, 4)
    start = F.when(n <= 2, 2).when((n == 3) & every(29), 4).when(n <= 4, 8).when(n == 7, 0).otherwise(6)
    end = F.when(n <= 2, 5).when(note, 9).when(n <= 4, start).when(n == 7, 2).otherwise(6)
    before = F.when((n == 1) & every(23), "xyz").otherwise(F.substr("text", start + 1, end - start))
    kind = F.when(note & (n == 2), "delete").when(note, "add").otherwise("edit")
    after = F.when(kind == "delete", "").otherwise(F.concat(F.lit("q"), F.col("l_quantity").cast("int")))
    revision = F.when(n <= 4, 2).when(n <= 7, 3).otherwise(n - 4)
    return rows.select(
        "chapter", F.concat(F.lit("line-"), n).alias("id"), "block", "language", kind.alias("kind"), start.alias("start"), end.alias("end"),
        before.alias("before_text"), after.alias("after_text"), (revision - 1).alias("base_revision"), revision.alias("applied_revision"), "n",
    )


def v45_snapshots(spark, sf_dir):
    """Every revision of every block; a ledger that does not fit leaves the first alone."""
    return ledger.snapshots(chapter_blocks(spark, sf_dir), chapter_changes(spark, sf_dir))


def e3_replayed(spark, sf_dir):
    """The last text of every block; where its own edits do not fit, its source."""
    return ledger.replayed(chapter_blocks(spark, sf_dir), chapter_changes(spark, sf_dir))


_LEDGER = """
src as (select o_orderkey as chapter, b.block, b.language, 'Order ' || o_orderkey || ' ' || b.block || ' of customer ' || o_custkey || ': ' || o_orderpriority as text
  from orders, (values ('a', 'en'), ('b', 'zh')) b(block, language)),
nl as (select *, l_orderkey as chapter, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem),
ln as (select *, chapter % 7 = 0 and n in (2, 4) as note, case when n <= 2 then 2 when n = 3 and chapter % 29 = 0 then 4 when n <= 4 then 8 when n = 7 then 0 else 6 end as s from nl where chapter in (select o_orderkey from orders)),
ch as (select chapter, n, case when n % 2 = 1 then 'a' else 'b' end as block, case when n <= 4 then 2 when n <= 7 then 3 else n - 4 end as revision,
  case when note and n = 2 then 'delete' when note then 'add' else 'edit' end as kind, s, case when n <= 2 then 5 when note then 9 when n <= 4 then s when n = 7 then 2 else 6 end as e,
  case when note and n = 2 then '' else 'q' || l_quantity::int end as a, n = 1 and chapter % 23 = 0 as wrong from ln),
nb as (select *, lag(s) over w as ps, lag(e) over w as pe from ch window w as (partition by chapter, block, revision order by s, e)),
-- a splice conflicts with the one before it where they overlap, or touch and one is empty
gr as (select chapter, block, revision, bool_or(wrong) as wrong, bool_or(kind <> 'edit') as noted, bool_or(pe > s or (pe >= s and (s = e or ps = pe))) as clash, list({'s': s, 'e': e, 'kind': kind, 'a': a} order by s desc, e desc) as xs from nb group by all),
tp as (select chapter, max(revision) as top from ch group by 1),
rep(chapter, block, language, revision, text, void) as (
  select chapter, block, language, 1, text, false from src
  union all
  select r.chapter, r.block, r.language, r.revision + 1, case when g.xs is null then r.text else
    list_reduce(list_prepend({'s': 0, 'e': 0, 'kind': '', 'a': r.text}, g.xs), lambda acc, x: {'s': 0, 'e': 0, 'kind': '', 'a':
      case x.kind when 'delete' then trim(regexp_replace(acc.a[1:x.s] || acc.a[x.e + 1:], '\\s{2,}', ' ', 'g')) when 'add' then trim(acc.a[1:x.e] || ' ' || x.a || acc.a[x.e + 1:]) else acc.a[1:x.s] || x.a || acc.a[x.e + 1:] end}).a end,
    r.void or coalesce(g.wrong or (g.clash and not g.noted), false)
  from rep r join tp on tp.chapter = r.chapter left join gr g on g.chapter = r.chapter and g.block = r.block and g.revision = r.revision + 1 where r.revision < tp.top)
"""

V45_SQL = (
    "with recursive"
    + _LEDGER
    + """, v as (select chapter, bool_or(void) as void from rep group by 1)
select chapter, language, block, revision, text, v.void from rep join v using (chapter) where revision = 1 or not v.void
"""
)

E3_SQL = (
    "with recursive"
    + _LEDGER
    + """, v as (select chapter, block, bool_or(void) as void from rep group by all)
select r.chapter, r.language, r.block, case when v.void then s.text else r.text end as text from rep r join v using (chapter, block) join src s on s.chapter = r.chapter and s.block = r.block left join tp on tp.chapter = r.chapter where r.revision = coalesce(tp.top, 1)
"""
)


def stored_ledger(spark, sf_dir):
    """The edits as a stored ledger with its history; faults by the chapter's number."""
    key, n = F.col("chapter"), F.col("n")
    rows = chapter_changes(spark, sf_dir, planted=False)
    group = Window.partitionBy("chapter", "block", "applied_revision").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum(F.length("after_text") - (F.col("end") - F.col("start"))).over(group), F.lit(0))
    kind = F.when(F.col("before_text") == "", "insert").otherwise("replace")
    rows = rows.withColumns({"after_start": at + ((key % 47 == 0) & (n == 1)).cast("int"), "operation": F.when((key % 53 == 0) & (n == 1), "delete").otherwise(kind), "last": F.max("applied_revision").over(Window.partitionBy("chapter"))})
    waits = (key % 59 == 0) & (n == 1)
    held = rows.select(
        "chapter", F.when((key % 31 == 0) & (n == 2), "line-1").otherwise(F.col("id")).alias("id"), "block", "language", F.when((key % 37 == 0) & (n == 1), 2).otherwise(F.col("base_revision")).alias("base_revision"), "operation", "before_text", "after_text", "start", "end",
        "after_start", (F.col("after_start") + F.length("after_text")).alias("after_end"), F.when(waits, "pending").otherwise("applied").alias("resolution"), F.lit(False).alias("requires_evidence"), F.lit(False).alias("supported"), F.when(~waits, F.col("applied_revision")).alias("applied_revision"),
        F.lit(None).cast("string").alias("reverts"), F.when((key % 61 == 0) & (n == 1), 0).alias("redo_place"), F.lit(5).alias("created_at"), F.when((key % 67 == 0) & (n == 1), 4).otherwise(5).alias("updated_at"), F.col("last").alias("revision"),
    )
    ids = F.collect_set(F.when(~waits, F.when((key % 31 == 0) & (n == 2), "line-1").otherwise(F.col("id"))))
    history = rows.groupBy("chapter", F.col("applied_revision").alias("revision")).agg(ids.alias("ids"))
    history = history.filter(~((key % 41 == 0) & (F.col("revision") == 2))).withColumn("ids", F.when((key % 43 == 0) & (F.col("revision") == 2), F.array_append("ids", "ghost")).otherwise(F.col("ids")))
    return held, history


def v71_ledger_faults(spark, sf_dir):
    """What is wrong with each stored ledger."""
    held, history = stored_ledger(spark, sf_dir)
    return ledger.faults(held, chapter_blocks(spark, sf_dir), history)


V71_SQL = """
with nl as (select l_orderkey as chapter, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n, l_quantity as q from lineitem where l_orderkey in (select o_orderkey from orders)),
c as (select chapter, count(*) as n, max(case when n = 1 then q end) as q from nl group by 1)
select chapter, 'duplicate_id' as code from c where chapter % 31 = 0 and n >= 2
union all select chapter, 'applied_base' from c where chapter % 37 = 0 and chapter % 59 <> 0
union all select chapter, 'void' from c where chapter % 37 = 0 and chapter % 59 <> 0
union all select chapter, 'history_gap' from c where chapter % 41 = 0
union all select chapter, 'history_missing' from c where chapter % 41 = 0 and (chapter % 59 <> 0 or n >= 2)
union all select chapter, 'history_unknown' from c where chapter % 43 = 0 and chapter % 41 <> 0
union all select chapter, 'after_range' from c where chapter % 47 = 0 and chapter % 59 <> 0
-- a pending edit no longer moves the one after it
union all select chapter, 'after_range' from c where chapter % 59 = 0 and n >= 3 and q < 10
union all select chapter, 'operation' from c where chapter % 53 = 0
union all select chapter, 'active_base' from c where chapter % 59 = 0 and not (chapter % 37 = 0 and n <= 4)
-- waiting alone, on a revision that nothing has made
union all select chapter, 'before_text' from c where chapter % 59 = 0 and chapter % 37 = 0 and n = 1
union all select chapter, 'redo_not_reverted' from c where chapter % 61 = 0
union all select chapter, 'clock' from c where chapter % 67 = 0
"""


def chapter_actions(spark, sf_dir):
    """Lines as what a reviewer does, in their order: edits at places the part says, undo, redo, apply, discard, revert."""
    n, part = F.col("n"), F.col("l_partkey")
    k = (part + F.col("l_suppkey")) % 12
    kind = F.when(k <= 6, "edit").when(k == 7, "undo").when(k == 8, "redo").when(k == 9, "apply").when(k == 10, "discard").otherwise("revert")
    start = (part % 30).cast("int")
    said = F.when(k == 0, "").when(k == 1, " 7 of them.").otherwise(F.concat(F.lit("w"), F.col("l_quantity").cast("int")))
    block = F.when(part % 3 == 0, "b").otherwise("a")
    return numbered_lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("chapter"), n.cast("long").alias("seq"), kind.alias("kind"), block.alias("block"), F.when(block == "a", "en").otherwise("zh").alias("language"), start.alias("start"), (start + k % 4).cast("int").alias("end"), said.alias("inserted"),
        F.concat(block, F.lit(":edit:"), n - 1).alias("target"), (part % 2 == 0).alias("supported"),
    )


def e1_transactions(spark, sf_dir):
    """The ledgers that the actions leave."""
    return ledger.transactions(chapter_blocks(spark, sf_dir), chapter_actions(spark, sf_dir))


def e4_outcomes(spark, sf_dir):
    """What came of each action."""
    return ledger.outcomes(chapter_blocks(spark, sf_dir), chapter_actions(spark, sf_dir))


QUERIES = {"n14_splices": n14_splices, "v45_snapshots": v45_snapshots, "e3_replayed": e3_replayed, "v71_ledger_faults": v71_ledger_faults, "e1_transactions": e1_transactions, "e4_outcomes": e4_outcomes}
ORACLE = {"n14_splices": N14_SQL, "v45_snapshots": V45_SQL, "e3_replayed": E3_SQL, "v71_ledger_faults": V71_SQL}
