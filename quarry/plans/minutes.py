"""Queries over meeting texts, which are conversations written down in ten layouts by their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import layouts
from quarry.sources.items import table


def meeting_texts(spark, sf_dir):
    """One text per conversation. Layouts: 0 stamped lines, 1 labels, 2 and 3 labels in brackets with a clock (every 20th of 3 turns the clock back), 4 bare labels with a clock, 5 words, 6 declared heads, 7 rows, 8 rows and half rows, 9 metadata and control characters."""
    c, t = F.col("conv_id"), F.col("turn")
    body = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    speaker = F.when(F.col("role") == "user", "Anna").when(F.col("role") == "assistant", "Ben Li").otherwise("Speaker 3")
    k = c % 10
    clock = F.concat(F.when((c % 20 == 3) & (t == 1), "08:0").otherwise("09:0"), t % 10)
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    said = {
        0: line((t + 1).cast("string"), ":05Speaker ", F.char(65 + t % 3), " ", body), 1: line(speaker, ": ", body), 2: line("[", speaker, "] 9:0", (t % 10).cast("string"), " AM\n", body), 3: line("[", speaker, "] ", clock, "\n", body, "\n"), 4: line(speaker, " 09:0", (t % 10).cast("string"), "\n", body),
        5: body, 6: line("<<< ", speaker, " | 9:0", (t % 10).cast("string"), " >>>\n", body), 7: line("09:0", (t % 10).cast("string"), ",", speaker, ",", body), 8: F.when(t % 2 == 0, line("09:0", (t % 10).cast("string"), ",", speaker, ",", body)).otherwise(line("x,", body)), 9: F.when(t % 2 == 0, line("Date: ", body)).otherwise(line("Anna: ", body, "\x07")),
    }
    text = None
    for layout, x in said.items():
        text = F.when(k == layout, x) if text is None else text.when(k == layout, x)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("said"))
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("all"))
    return packed.select(F.col("conv_id").alias("id"), F.array_join(F.transform("all", lambda x: x["said"]), "\n").alias("text"))


_TOLD = r"""
told as (select conv_id as id, conv_id % 10 as k, turn as t, row_number() over (partition by conv_id order by turn) as i, count(*) over (partition by conv_id) as n, role,
  case role when 'user' then 'Anna' when 'assistant' then 'Ben Li' else 'Speaker 3' end as who, trim(regexp_replace(text, '[^\p{L}]+', ' ', 'g')) as body from conversations),
-- bare labels count where they meet again; roles always do
bare as (select id, bool_or(who = 'Speaker 3' or m >= 2) as on_, bool_or(who <> 'Speaker 3' and m < 2) as odd, any_value(n) as n from (select id, who, n, count(*) over (partition by id, who) as m from told where k = 4) group by 1),
lay as (select id, any_value(k) as k, any_value(t.n) as n, case when any_value(k) = 2 or (any_value(k) = 3 and not (id % 20 = 3 and any_value(t.n) >= 2)) then 'speaker-time' when any_value(k) = 3 then 'invalid'
  when any_value(k) = 4 then case when any_value(b.on_) then case when any_value(b.odd) then 'invalid' else 'speaker-time' end when any_value(b.n) > 1 then 'invalid' else 'plain' end end as layout from told t left join bare b using (id) group by id)"""


def l1_formats(spark, sf_dir):
    """Every text's format, blocks of speaker and time tried first."""
    return layouts.formats(meeting_texts(spark, sf_dir), "id", "text")


L1_SQL = f"""with {_TOLD} select id, coalesce(layout, case when k = 0 then 'timestamped' when k = 1 then 'speaker-labeled' else 'plain' end) as format from lay"""


def l2_l3_w4_records(spark, sf_dir):
    """The records of all texts that can be read."""
    found = layouts.records(meeting_texts(spark, sf_dir), "id", "text")
    return found.select("id", F.col("order").cast("long").alias("order"), "clock", "speaker", F.sha2("text", 256).alias("text_sha256"), F.col("source_line").cast("long").alias("source_line"))


L2_SQL = f"""with {_TOLD},
-- a turn's first and second line; a blank third one in layout 3
ls as (select id, k, i, n, case when k in (2, 3, 4, 6) then 0 end as part, case k when 0 then body when 1 then body when 2 then '[' || who || '] 9:0' || t % 10 || ' AM' when 3 then '[' || who || '] ' || case when id % 20 = 3 and t = 1 then '08:0' else '09:0' end || t % 10 when 4 then who || ' 09:0' || t % 10
  when 5 then body when 6 then '<<< ' || who || ' | 9:0' || t % 10 || ' >>>' when 7 then '09:0' || t % 10 || ',' || who || ',' || body when 8 then case when t % 2 = 0 then '09:0' || t % 10 || ',' || who || ',' || body else 'x,' || body end when 9 then case when t % 2 = 0 then 'Date: ' || body else 'Anna: ' || body || chr(7) end end as line,
  case k when 0 then (t + 1) || ':05' end as clock, case k when 0 then chr((65 + t % 3)::int) when 1 then who end as speaker from told),
al as (select *, case when part is null then i when k = 3 then 3 * i - 2 else 2 * i - 1 end as source_line from ls union all select l.id, l.k, l.i, l.n, 1, d.body, null, null, case when l.k = 3 then 3 * l.i - 1 else 2 * l.i end from ls l join told d using (id, i) where l.part = 0)
select al.id, row_number() over (partition by al.id order by source_line) as "order", clock, speaker, sha256(line) as text_sha256, source_line from al join lay using (id) where layout is null or layout = 'plain'
union all select l.id, i, case when d.k = 2 then '9:0' || t % 10 || ' AM' else '09:0' || t % 10 end, who, sha256(body), case when d.k = 3 then 3 * i - 2 else 2 * i - 1 end from lay l join told d on d.id = l.id where l.layout = 'speaker-time'"""


def l4_speaker_time(spark, sf_dir):
    """Every text's verdict, and the records of those in blocks of speaker and time."""
    found, records = layouts.speaker_time(meeting_texts(spark, sf_dir), "id", "text")
    joined = found.join(records, "id", "left")
    return joined.select("id", "layout", F.col("order").cast("long").alias("order"), "clock", "speaker", F.sha2("text", 256).alias("text_sha256"), F.col("source_line").cast("long").alias("source_line"))


L4_SQL = f"""with {_TOLD}
select l.id, layout, i as "order", case when d.k = 2 then '9:0' || t % 10 || ' AM' when d.k is not null then '09:0' || t % 10 end as clock, who as speaker, sha256(body) as text_sha256, case when d.k = 3 then 3 * i - 2 else 2 * i - 1 end as source_line
from lay l left join told d on d.id = l.id and l.layout = 'speaker-time'"""


def l5_structures(spark, sf_dir):
    """What structure each text has beyond the known layouts."""
    return layouts.structures(meeting_texts(spark, sf_dir), "id", "text")


L5_SQL = f"""with {_TOLD} select id, case when n < 2 then 'plain' when k in (2, 3, 6, 7) then 'unsupported' when k = 8 or (k = 9 and n >= 4) then 'invalid' else 'plain' end as structure from lay"""


def plans(texts):
    """Plans: rows for layout 7, declared heads for all others; every 30th is of another text, every 40th lacks a field."""
    row = F.col("id") % 10 == 7
    fields = F.when(F.col("id") % 40 == 7, F.array(F.lit("speaker"), F.lit("clock"))).when(row, F.array(*map(F.lit, ("timestamp", "speaker", "body")))).otherwise(F.array(*map(F.lit, ("speaker", "timestamp"))))
    return texts.select(
        "id", F.sha2(F.when(F.col("id") % 30 == 6, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("source_digest"), F.when(row, "row").otherwise("header_body").alias("record_form"), F.when(row, "record_separator").otherwise("body").alias("blank_lines"),
        F.when(row, "").otherwise("<<< ").alias("prefix"), F.when(row, ",").otherwise(" | ").alias("separator"), F.when(row, "").otherwise(" >>>").alias("suffix"), fields.alias("fields"),
    )


def l6_planned(spark, sf_dir):
    """Every text read by its plan: why not, or its records."""
    texts = meeting_texts(spark, sf_dir)
    outcomes, records = layouts.planned(texts, plans(texts), "id", "text")
    joined = outcomes.join(records, "id", "left")
    return joined.select("id", "code", F.col("order").cast("long").alias("order"), "clock", "speaker", F.sha2("text", 256).alias("text_sha256"), F.col("source_line").cast("long").alias("source_line"))


L6_SQL = f"""with {_TOLD}, c as (select *, case when id % 30 = 6 then 'SOURCE_DIGEST_MISMATCH' when id % 40 = 7 then 'PLAN_CONTRACT_INVALID' when k not in (6, 7) or n < 2 then 'SOURCE_LAYOUT_MISMATCH' end as code from lay)
select c.id, code, i as "order", case when c.k = 7 then '09:0' || t % 10 else '9:0' || t % 10 end as clock, who as speaker, sha256(body) as text_sha256, case when c.k = 7 then i else 2 * i - 1 end as source_line from c join told d using (id) where code is null
union all select id, code, null, null, null, null, null from c where code is not null"""

QUERIES = {f.__name__: f for f in (l1_formats, l2_l3_w4_records, l4_speaker_time, l5_structures, l6_planned)}
ORACLE = {"l1_formats": L1_SQL, "l2_l3_w4_records": L2_SQL, "l4_speaker_time": L4_SQL, "l5_structures": L5_SQL, "l6_planned": L6_SQL}
