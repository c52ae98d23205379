"""Queries over digests: strict JSON of events, receipts of conversations, and what changed between two versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import canonical
from quarry.operators import receipts
from quarry.sources.items import table


def event_texts(spark, sf_dir):
    """Turns as JSON of events, spelled in five ways: plain, keys turned round, numbers as 1e3 and 2.0, a key twice, an integer too large."""
    c, t = F.col("conv_id"), F.col("turn")
    quote = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)
    text, role = quote(F.col("text")), quote(F.col("role"))
    source = lambda n: F.concat(F.lit('"source":{"system":"chat","line":'), n, F.lit(',"record_id":"line-'), t + 1, F.lit('"}'))
    head = F.concat(F.lit('"event_id":"e'), c, F.lit("-"), t, F.lit('","event_type":"message"'))
    payload = lambda n, two: F.concat(F.lit('"payload":{"role":'), role, F.lit(',"text":'), text, F.lit(',"n":'), n, F.lit(',"two":'), two, F.lit(',"half":0.5,"none":null,"yes":true}'))
    join = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    plain = join(head, payload(F.lit("1000"), F.lit("2")), source(t))
    turned = join(source(t), payload(F.lit("1e3"), F.lit("2.0")), head)
    way = (c + t) % 5
    spelled = F.when(way == 0, plain).when(way == 1, turned).when(way == 2, F.concat(F.lit(" "), plain, F.lit("\n"))).when(way == 3, join(head, head, payload(F.lit("1000"), F.lit("2")), source(t))).otherwise(join(head, payload(F.lit("9007199254740993"), F.lit("2")), source(t)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", spelled.alias("json"))


def c8_strict_json(spark, sf_dir):
    """Canonical text, digests and fault of every event: equal normal digests for equal values, none for a repeated key."""
    found = event_texts(spark, sf_dir).select("conv_id", "turn", canonical.strict_json(F.col("json")).alias("x"))
    return found.select("conv_id", "turn", "x.digest", "x.normal_digest", "x.content_digest", "x.code")


def _c8_sql():
    keys = lambda *pairs: "'[\"object\",[' || " + " || ',' || ".join(f"'[\"{k}\",' || {v} || ']'" for k, v in pairs) + " || ']]'"
    string = lambda x: f"'[\"string\",' || {x} || ']'"
    payload = keys(("half", "'[\"number\",\"f:3fe0000000000000\"]'"), ("n", "'[\"number\",\"i:1000\"]'"), ("none", "'[\"null\"]'"), ("role", string("to_json(role)")), ("text", string("to_json(text)")), ("two", "'[\"number\",\"i:2\"]'"), ("yes", "'[\"boolean\",true]'"))
    system = ("system", "'[\"string\",\"chat\"]'")
    whole = keys(("line", "'[\"number\",\"i:' || turn || '\"]'"), ("record_id", "'[\"string\",\"line-' || (turn + 1) || '\"]'"), system)
    event = lambda source: keys(("event_id", "'[\"string\",\"e' || conv_id || '-' || turn || '\"]'"), ("event_type", "'[\"string\",\"message\"]'"), ("payload", payload), ("source", source))
    plain = "'{\"event_id\":\"e' || conv_id || '-' || turn || '\",\"event_type\":\"message\",\"payload\":{\"half\":0.5,\"n\":' || case way when 1 then '1000.0' when 4 then '9007199254740993' else '1000' end || ',\"none\":null,\"role\":' || to_json(role) || ',\"text\":' || to_json(text) || ',\"two\":' || case way when 1 then '2.0' else '2' end || ',\"yes\":true},\"source\":{\"line\":' || turn || ',\"record_id\":\"line-' || (turn + 1) || '\",\"system\":\"chat\"}}'"
    return f"""
with c as (select *, (conv_id + turn) % 5 as way from conversations)
select conv_id, turn, case when way < 3 then sha256({plain}) end as digest, case when way < 3 then sha256({event(whole)}) end as normal_digest,
  case when way < 3 then sha256({event(keys(system))}) end as content_digest, case way when 3 then 'duplicate_key' when 4 then 'unsafe_integer' end as code from c
"""


def dialogue(spark, sf_dir):
    """Turns of conversations as dialogue; every 19th conversation names an event otherwise than its item, every 23rd has an item of its neighbour."""
    c = F.col("conv_id")
    item = F.concat(F.lit("c"), F.when((c % 23 == 0) & (F.col("turn") == 1), c + 1).otherwise(c), F.lit("-"), F.col("turn"))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), c).alias("document_id"), F.lit("trajectory").alias("document_kind"), F.when((c % 19 == 0) & (F.col("turn") == 0), "other").otherwise(item).alias("event_id"), item.alias("item_id"),
        (F.col("turn") + 1).alias("sequence"), "role", F.lit(None).cast("string").alias("timestamp"), "text",
    )


_DIALOGUE = """
d as (select 'conv-' || conv_id as document_id, conv_id as c, turn, 'c' || case when conv_id % 23 = 0 and turn = 1 then conv_id + 1 else conv_id end || '-' || turn as item_id, turn + 1 as sequence, role, text from conversations),
t as (select *, case when c % 19 = 0 and turn = 0 then 'other' else item_id end as event_id from d),
l as (select *, sha256('{"eventId":' || to_json(event_id) || ',"itemId":' || to_json(item_id) || ',"role":' || to_json(role) || ',"sequence":' || sequence || ',"textByteLength":' || strlen(text) || ',"textDigest":"' || sha256(text) || '","timestamp":null}') as leaf from t),
m as (select max(sequence) as most from l),
"""


def g9_receipts(spark, sf_dir):
    """A receipt of every conversation: what it holds, the top of its tree of four places a block, its first fault."""
    return receipts.receipts(dialogue(spark, sf_dir), fan=4)


G9_SQL = (
    "with recursive"
    + _DIALOGUE
    + """tr(k, most, nodes) as (
  select 0, (select most from m), (select list({'d': document_id, 'n': sequence, 'x': leaf}) from l)
  union all
  select k + 1, most // 4, (select list({'d': d, 'n': n, 'x': x}) from (select u.x.d as d, u.x.n // 4 as n, sha256(string_agg(u.x.x, chr(10) order by u.x.n)) as x from (select unnest(tr.nodes) as x) u group by 1, 2)) from tr where most > 0),
top as (select u.x.d as document_id, u.x.x as digest from (select unnest(nodes) as x from tr where most = 0) u),
sh as (select item_id from l group by 1 having count(*) > 1),
f as (select document_id, count(*) as n_turns, sum(strlen(text))::bigint as n_bytes, sum(length(text))::bigint as n_chars, min(case when event_id <> item_id then 'identity_not_canonical' end) as code, bool_or(item_id in (select item_id from sh)) as odd from l group by 1)
select document_id, n_turns, n_bytes, n_chars, digest, coalesce(code, case when odd then 'item_shared' end) as code from f join top using (document_id)
"""
)


def edited(spark, sf_dir):
    """Another version: every 17th conversation has its second turn changed, every 29th lacks its last ones, every 31st has one more."""
    now = dialogue(spark, sf_dir)
    c = F.regexp_extract("document_id", "([0-9]+)$", 1).cast("long")
    changed = now.withColumn("text", F.when((c % 17 == 0) & (F.col("sequence") == 2), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).filter(~((c % 29 == 0) & (F.col("sequence") > 3)))
    more = now.filter((c % 31 == 0) & (F.col("sequence") == 1)).withColumn("sequence", F.lit(400).cast("long")).withColumn("item_id", F.concat("item_id", F.lit("x")))
    return changed.unionByName(more)


def v10_changed_turns(spark, sf_dir):
    """Where two versions of all conversations differ, found from the tops of their trees."""
    return receipts.changed_turns(dialogue(spark, sf_dir), edited(spark, sf_dir), fan=4)


V10_SQL = """
select 'conv-' || conv_id as document_id, turn + 1 as sequence, case when conv_id % 29 = 0 and turn >= 3 then 'removed' else 'changed' end as change
from conversations where (conv_id % 29 = 0 and turn >= 3) or (conv_id % 17 = 0 and turn = 1)
union all select 'conv-' || conv_id, 400, 'added' from conversations where conv_id % 31 = 0 and turn = 0
"""


def v8_corpus_receipt(spark, sf_dir):
    """The corpus as one tree of its receipts: digests of all nodes down to the documents' groups."""
    return receipts.corpus_tree(receipts.receipts(dialogue(spark, sf_dir), fan=4))


V8_SQL = (
    G9_SQL.replace("select document_id, n_turns, n_bytes, n_chars, digest, coalesce(code, case when odd then 'item_shared' end) as code from f join top using (document_id)", "")
    + """, r as (select sha256(document_id) as name, sha256('{"digest":"' || digest || '","documentId":' || to_json(document_id) || ',"nBytes":' || n_bytes || ',"nTurns":' || n_turns || '}') as x from f join top using (document_id)),
g as (select name[1:2] as node, sha256(string_agg(x, chr(10) order by name)) as digest, count(*) as n_documents from r group by 1)
select 2 as level, node, digest, n_documents from g
union all select 0, '', sha256(string_agg(digest, chr(10) order by node)), sum(n_documents)::bigint from g
"""
)

QUERIES = {"c8_strict_json": c8_strict_json, "g9_receipts": g9_receipts, "v10_changed_turns": v10_changed_turns, "v8_corpus_receipt": v8_corpus_receipt}
ORACLE = {"c8_strict_json": _c8_sql(), "g9_receipts": G9_SQL, "v10_changed_turns": V10_SQL, "v8_corpus_receipt": V8_SQL}
