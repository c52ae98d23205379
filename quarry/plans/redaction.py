"""Queries over known fragments: where they stand, texts and nested values without them, proposals and matches checked.

The roster is what the benchmark holds: its sentences and their first words.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import diff
from quarry.functions import records as rec
from quarry.operators import fragments, ledger, proposals
from quarry.plans.edits import N14_SQL, chapter_blocks
from quarry.sources.items import table


def roster(spark, sf_dir):
    """Sentences of the benchmark, and of each its first two words: the longer one wins where both stand."""
    said = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.!?\n]+ *")).alias("k", "said"))
    both = said.select((F.col("item_id") * 10_000 + F.col("k") * 2).alias("fragment_id"), F.col("said").alias("fragment"))
    short = said.select((F.col("item_id") * 10_000 + F.col("k") * 2 + 1).alias("fragment_id"), F.regexp_extract("said", r"^\S+ \S+", 0).alias("fragment"))
    return both.unionByName(short).withColumn("category", F.lit("confidential")).filter("length(fragment) > 3")


_ROSTER = r"""
said as (select item_id, unnest(range(len(ss))) as k, unnest(ss) as s from (select item_id, string_split_regex(text, '[.!?\n]+ *') as ss from benchmark)),
ros as (select min(id) as id, f from (select item_id * 10000 + k * 2 as id, s as f from said union all select item_id * 10000 + k * 2 + 1, regexp_extract(s, '^\S+ \S+') from said) where length(f) > 3 group by f),
-- longest first: of those at one place the longest is taken
pat as (select string_agg(regexp_escape(f), '|' order by length(f) desc, f) as p from ros)"""


def j16_known_fragments(spark, sf_dir):
    """How many texts each known fragment stands in, and how often."""
    found = fragments.occurrences(table(spark, sf_dir, "documents"), roster(spark, sf_dir), "doc_id", "text")
    return found.groupBy("fragment_id").agg(F.count_distinct("id").alias("n_texts"))


J16_SQL = f"with {_ROSTER} select id as fragment_id, count(*) as n_texts from documents, ros where contains(text, f) group by 1"


def g5_known_fragments(spark, sf_dir):
    """Texts with all known fragments hidden: the leftmost first, of those at one place the longest."""
    hidden = fragments.redacted(table(spark, sf_dir, "documents"), roster(spark, sf_dir), "text", "hidden")
    return hidden.select("doc_id", F.sha2("hidden", 256).alias("hidden_sha256"))


G5_SQL = f"""with {_ROSTER} select doc_id, sha256(regexp_replace(text, p, '<redacted category="confidential"/>', 'g')) as hidden_sha256 from documents, pat"""


def openings(spark, sf_dir):
    """The first words of conversations' first turns, as fragments."""
    first = table(spark, sf_dir, "conversations").filter("turn <= 1")
    return first.select((F.col("conv_id") * 2 + F.col("turn")).alias("fragment_id"), F.regexp_extract("text", r"^\S+ \S+", 0).alias("fragment"), F.lit("third-party").alias("category")).filter("length(fragment) > 3")


def v41_nested_values(spark, sf_dir):
    """Conversations as nested values, every string at any depth without the fragments."""
    t = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.struct(F.col("text").alias("body"), F.length("text").alias("n")).alias("said"))))
    packed = t.groupBy("conv_id").agg(turns.alias("turns"), F.min_by("text", "turn").alias("head"))
    nested = packed.select("conv_id", F.struct("head", "turns", F.create_map(F.lit("last"), F.element_at("turns", -1)["said"]["body"]).alias("by_name"), F.lit(3).alias("n")).alias("value"))
    clean = fragments.redacted_value(nested, openings(spark, sf_dir), "value")
    v = F.col("value")
    return clean.select("conv_id", F.sha2(v["head"], 256).alias("head"), F.sha2(F.array_join(F.transform(v["turns"], lambda x: F.concat(x["role"], F.lit(":"), x["said"]["body"], F.lit(":"), x["said"]["n"])), "|"), 256).alias("turns"), F.sha2(v["by_name"]["last"], 256).alias("last"))


V41_SQL = r"""
with ros as (select distinct regexp_extract(text, '^\S+ \S+') as f from conversations where turn <= 1 and length(regexp_extract(text, '^\S+ \S+')) > 3),
pat as (select string_agg(regexp_escape(f), '|' order by length(f) desc, f) as p from ros),
c as (select conv_id, turn, role, length(text) as n, regexp_replace(text, p, '<redacted category="third-party"/>', 'g') as body from conversations, pat)
select conv_id, sha256(min_by(body, turn)) as head, sha256(string_agg(role || ':' || body || ':' || n, '|' order by turn)) as turns, sha256(max_by(body, turn)) as last from c group by 1
"""


def n6_overlapping(spark, sf_dir):
    """Every place of a turn where its third and fourth letters stand, overlapping ones too."""
    rows = table(spark, sf_dir, "conversations").withColumn("starts", rec.overlapping_ranges(F.col("text"), F.substring("text", 3, 2)))
    return rows.select("conv_id", "turn", F.size("starts").cast("long").alias("n"), F.sha2(F.array_join(F.col("starts").cast("array<string>"), ","), 256).alias("starts_sha256"))


N6_SQL = """with s as (select conv_id, turn, list_filter(range(length(text) - length(text[3:4]) + 1), lambda i: length(text[3:4]) > 0 and text[i + 1:i + length(text[3:4])] = text[3:4]) as starts from conversations)
select conv_id, turn, len(starts) as n, sha256(array_to_string(starts, ',')) as starts_sha256 from s"""


def n13_needs_evidence(spark, sf_dir):
    """Whether what turns a turn into the next one brings a claim of its own; half of them at the end of their block."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next is not null")
    found = pairs.select("conv_id", "turn", "text", diff.splice(F.col("text"), F.col("next")).alias("x")).filter("x is not null")
    before = F.substr("text", F.col("x.start") + 1, F.col("x.end") - F.col("x.start"))
    kind = F.when(before == "", "insert").when(F.col("x.inserted") == "", "delete").otherwise("replace")
    return found.select("conv_id", "turn", ledger.needs_evidence(kind, before, F.col("x.inserted"), F.col("x.start"), F.col("x.end"), F.length("text")).alias("needs_evidence"))


N13_SQL = (
    N14_SQL.rsplit("select conv_id, turn, case", 1)[0]
    + r""", x as (select conv_id, turn, head = 0 or tail = 0 as edge, substr(a, head + 1, length(a) - tail - head) as old, substr(b, head + 1, length(b) - tail - head) as new from t where a <> b)
select conv_id, turn, trim(new, E' \t\n\r') <> '' and ((regexp_matches(new, '[0-9]') and not regexp_matches(old, '[0-9]')) or regexp_matches(new, 'https?://|[A-Za-z]:\\|/([^\s/]+/){2,}') or (contains(new, chr(10)) and not contains(old, chr(10)))
  or len(regexp_extract_all(new, '[.!?。！？](\s|$)')) > len(regexp_extract_all(old, '[.!?。！？](\s|$)')) or (edge and length(trim(new, E' \t\n\r')) >= 32 and regexp_matches(trim(new, E' \t\n\r'), '[.!?。！？]$'))) as needs_evidence from x
"""
)


def chapter_proposals(spark, sf_dir):
    """Chapters' texts with two marks, the number of the order and of its customer; faults by the chapter's number."""
    key = F.col("chapter")
    blocks = chapter_blocks(spark, sf_dir).filter("block = 'a'").withColumn("cust", F.regexp_extract("text", "customer ([0-9]+)", 1))
    rows = blocks.withColumn("k", F.length(key.cast("string"))).withColumn("c", F.length("cust"))
    every = lambda n: key % n == 0
    proposed = F.concat(F.lit("Order "), F.when(every(61), key.cast("string")).otherwise("X"), F.when(every(53), " a off customer ").otherwise(" a of customer "), F.lit("YY"), F.substr("text", F.col("k") + F.col("c") + 22), F.when(every(67), "!").otherwise(""))
    x = F.when(every(61), F.col("k")).otherwise(F.lit(1))
    shift = x + F.when(every(53), 1).otherwise(0)
    mark = lambda a, b, c, d, name: F.struct(a.cast("int").alias("os"), b.cast("int").alias("oe"), c.cast("int").alias("ps"), d.cast("int").alias("pe"), name.alias("category"))
    one = mark(F.lit(6), F.col("k") + 6, F.lit(6), x + 6, F.when(every(41), "Bad One").otherwise("private-personal"))
    end = F.col("k") + 21 + F.col("c")
    two = mark(F.when(every(47), F.lit(5)).otherwise(F.col("k") + 21), F.when(every(43), F.lit(9_999)).otherwise(end), shift + 21, shift + 23, F.lit("third-party"))
    text = F.when(every(71), F.concat(proposed, F.lit(" password: hunter22"))).otherwise(proposed)
    proposal = rows.filter(~every(31)).select(F.when(every(29), -key).otherwise(key).alias("target_id"), F.sha2(F.when(every(37), F.lit("other")).otherwise(F.col("text")), 256).alias("content_digest"), text.alias("proposed"), F.array(two, one).alias("occurrences"))
    again = rows.filter(every(23)).select(key.alias("target_id"), F.sha2("text", 256).alias("content_digest"), F.col("text").alias("proposed"), F.array().cast(proposal.schema["occurrences"].dataType).alias("occurrences"))
    return rows.select(key.alias("target_id"), F.col("text").alias("content"), "cust"), proposal.unionByName(again)


def g12_proposals(spark, sf_dir):
    """The first fault of each proposal."""
    targets, given = chapter_proposals(spark, sf_dir)
    return proposals.proposal_codes(targets.drop("cust"), given, targets.filter("target_id % 73 <> 0").select("target_id"))


G12_SQL = """
with o as (select o_orderkey as k from orders),
p as (select k, case when k % 29 = 0 then -k else k end as target_id, case when k % 29 = 0 then 'target_unknown' when k % 23 = 0 then 'target_repeated' when k % 37 = 0 then 'content_digest' when k % 41 = 0 then 'occurrence_shape' when k % 43 = 0 then 'occurrence_range'
  when k % 47 = 0 then 'occurrence_order' when k % 53 = 0 then 'gap' when k % 61 = 0 then 'occurrence_unchanged' when k % 67 = 0 or k % 71 = 0 then 'tail' when k % 73 = 0 then 'not_flagged' end as code from o where k % 31 <> 0)
select target_id, code from p
union all select k, case when k % 29 = 0 or k % 31 = 0 then case when k % 73 = 0 then null else 'flagged_unchanged' end else 'target_repeated' end from o where k % 23 = 0
union all select k, 'proposal_missing' from o where (k % 31 = 0 or k % 29 = 0) and k % 23 <> 0
"""


def g13_matches(spark, sf_dir):
    """How known source texts in chapters are explained: customers' names as sources, every 11th a credential; faults by the chapter's number."""
    targets, given = chapter_proposals(spark, sf_dir)
    rows = targets.join(given.filter("size(occurrences) > 0").select("target_id", "proposed", "occurrences"), "target_id").withColumn("k", F.length(F.col("target_id").cast("string")))
    key, c = F.col("target_id"), F.col("cust").cast("long")
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.concat(F.lit("customer "), "c_custkey", F.lit(":")).alias("text"), F.when(F.col("c_custkey") % 11 == 0, "api-token").otherwise("person").alias("category"))
    start = F.col("k") + 12
    # an occurrence from the word before the number on, where the chapter's number says so
    wide = F.transform("occurrences", lambda x: x.withField("os", F.when((x["category"] == "third-party") & (key % 3 != 0), start.cast("int")).otherwise(x["os"])).withField("oe", F.when(x["category"] == "third-party", x["oe"] + 1).otherwise(x["oe"])).withField("ps", F.when(key % 7 == 0, 0).otherwise(x["ps"])).withField("pe", F.when(key % 7 == 0, 2_000).otherwise(x["pe"])))
    made = rows.select(key, "content", F.when(key % 7 == 0, F.col("content")).otherwise(F.col("proposed")).alias("proposed"), wide.alias("occurrences"))
    relation = F.when(key % 5 == 0, "unrelated").when(key % 13 == 0, "odd").otherwise("inherited")
    told = rows.filter(key % 17 != 0).select(key, c.alias("source_id"), start.alias("start"), (start + 10 + F.length("cust")).alias("end"), relation.alias("relation"), F.lit("named").alias("reason"))
    more = told.filter(key % 19 == 0).withColumn("start", F.col("start") + 1)
    return proposals.match_codes(made, sources, told.unionByName(more)).groupBy("code").agg(F.count("*").alias("n"))


G13_SQL = """
with o as (select o_orderkey as k, o_custkey as c from orders where o_orderkey % 31 <> 0 and o_orderkey % 29 <> 0),
f as (select 'match_missing' as code from o where k % 17 = 0
  union all select case when k % 5 = 0 then case when c % 11 = 0 then 'credential_unrelated' end when k % 13 = 0 then 'match_shape' when k % 3 = 0 and k % 47 <> 0 then 'not_covered' when k % 7 = 0 then 'still_there' end from o where k % 17 <> 0
  union all select case when k % 5 <> 0 and k % 13 = 0 then 'match_shape' else 'match_unfounded' end from o where k % 19 = 0 and k % 17 <> 0)
select code, count(*) as n from f where code is not null group by 1
"""


QUERIES = {f.__name__: f for f in (j16_known_fragments, g5_known_fragments, v41_nested_values, n6_overlapping, n13_needs_evidence, g12_proposals, g13_matches)}
ORACLE = {"j16_known_fragments": J16_SQL, "g5_known_fragments": G5_SQL, "v41_nested_values": V41_SQL, "n6_overlapping": N6_SQL, "n13_needs_evidence": N13_SQL, "g12_proposals": G12_SQL, "g13_matches": G13_SQL}
