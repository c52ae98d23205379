"""One query per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, exact_dedup, html_text, mixing, ngram_join, pii, prefix_trie, quality, secrets, token_files, toxicity, vector_codes, warc
from quarry.llm.common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), width=3, percent=90)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extracted(table(spark, sf_dir, "pages"))
    return texts.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return held.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_matched").alias("n_matched"), F.max("containment").alias("containment"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_index(token_files.write_tokens(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_archive(table(spark, sf_dir, "pages"))


OP2_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) end) ss from w),
n as (select doc_id, len(ss) n from s),
-- equal sets are one node, so that copies meet once
k as (select doc_id, n, case when n > 0 then md5(array_to_string(list_sort(ss), chr(10))) else 'empty' || doc_id end as node, ss from s join n using (doc_id)),
r as (select node, min(n) n, any_value(ss) ss from k where n > 0 group by 1),
x as (select node, n, unnest(ss) g from r),
p as (select a.node u, b.node v from x a join x b on a.g = b.g and a.node < b.node and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by a.node, b.node, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e as (select u, v from p union all select v, u from p),
c(node, least_id) as (select node, min(doc_id) from k group by 1
  union select e.v, c.least_id from c join e on e.u = c.node),
m as (select node, min(least_id) component_id from c group by 1)
select k.doc_id, k.n as n_shingles, m.component_id from k join m using (node)
"""

OP6_SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') ws from documents),
d as (select distinct doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) s from w where len(ws) >= 5),
v as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') ws from benchmark),
i as (select distinct item_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) s from v where len(ws) >= 5),
n as (select item_id, count(*) n_shingles from i group by 1),
m as (select doc_id, item_id, count(*) n_matched from d join i using (s) group by 1, 2)
select doc_id, item_id, n_shingles, n_matched, round(n_matched / n_shingles, 6) containment
from m join n using (item_id) where n_matched >= ceil(n_shingles * 0.8 - 1e-9)
"""

OP9_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) keep_id, count(*) over (partition by text_sha256) group_size,
       doc_id = min(doc_id) over (partition by text_sha256) kept, text_sha256
from d
"""

OP11_SQL = r"""
with own as (select conv_id c, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) p from conversations where conv_id is not null),
-- crc32 of the decimal id, bit by bit
hs as (select c, (list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda x: ord(x)::bigint)), lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)), lambda a, i: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end))) crc from (select distinct c from own)),
h as (select c, xor(crc, 4294967295) % 9 h from hs),
re as (select h.c, o.p, o.role, o.text from h join own o on o.c = h.c - h.c % 5 and o.p <= h.h
       union all select h.c, o.p + 1000000, o.role, o.text from h join own o on o.c = h.c and o.p > h.h),
t as (select c, row_number() over (partition by c order by p) d, md5(length(role) || ':' || role || text) k, strlen(text) b from re),
o as (select c, 0 d, '' node, 0 b from h union all select c, d, md5(array_to_string(list(k) over (partition by c order by d), ',')) node, b from t),
n as (select c, max(d) n from o group by 1),
v as (select node, d, min(o.c) own, count(*) n_convs, any_value(b) b, bool_and(d = n) bare, string_agg(case when d = n then o.c end, ',' order by o.c) ends from o join n using (c) group by 1, 2),
-- a node's way down, along its owner's path
w as (select a.node up, sum((u.n_convs - 1) * u.b) saved, sum(u.bare::int) leaves, sum((u.d = a.d + 1)::int) children from v u join o a on a.c = u.own and a.d <= u.d group by 1)
select v.own conv_id, v.d depth, p.own parent_conv_id, v.n_convs, w.children::bigint n_children, w.leaves::bigint n_leaves, w.saved::bigint saved_tokens, sha256(coalesce(v.ends, '')) ends_sha256
from v join w on w.up = v.node left join o a on a.c = v.own and a.d = v.d - 1 left join v p on p.node = a.node
"""

ROUND_SQL = """,
a{k} as (select v.vec_id, v.part, min(({distance}) * 256 + b.e) k from parts v join b{k} b using (part) group by 1, 2),
m{k} as (select a.part, a.k % 256 e, j, sum(x) s, count(*) n from a{k} a join comps c using (vec_id, part) group by 1, 2, 3),
b{next} as (select part, e, list(case when s is null then x else (s - ((s % n) + n) % n) // n end order by j) p from (select part, e, unnest(p) x, generate_subscripts(p, 1) j from b{k}) left join m{k} using (part, e, j) group by 1, 2)"""
DISTANCE_SQL = "list_sum(list_transform(list_zip(v.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
OP12_SQL = (
    """
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select vec_id, label, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] p from kept, range(4) r(part)),
comps as (select vec_id, part, unnest(p) x, generate_subscripts(p, 1) j from parts),
first as (select vec_id, row_number() over (order by vec_id) - 1 e from kept qualify e < 256),
b0 as (select part, e, p from parts join first using (vec_id))"""
    + "".join(ROUND_SQL.format(k=k, next=k + 1, distance=DISTANCE_SQL) for k in range(4))
    + """,
z as (select vec_id, label, part, min(("""
    + DISTANCE_SQL
    + """) * 256 + b.e) k from parts v join b4 b using (part) group by 1, 2, 3),
y as (select vec_id, label, lower(string_agg(lpad(to_hex(k % 256), 2, '0'), '' order by part)) code, sum(k // 256)::bigint error from z group by 1, 2),
s as (select sha256(string_agg(x, ',' order by part, e, j)) codebooks_sha256 from (select part, e, unnest(p) x, generate_subscripts(p, 1) j from b4))
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from y, s
"""
)

OP13_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) least from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes < 100 or page_id = least then 'response' else 'revisit' end record_type,
       case when payload_bytes >= 100 and page_id > least then least end refers_to
from f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scans": op1_secret_scans,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_pii": op4_pii,
        "op5_html_extraction": op5_html_extraction,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_token_files": op7_token_files,
        "op8_toxicity": op8_toxicity,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_mixing": op10_mixing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_vector_codes": op12_vector_codes,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op6_benchmark_decontamination": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_warc": OP13_SQL}
