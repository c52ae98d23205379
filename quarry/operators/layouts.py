"""Meeting layouts: blocks of speaker and time, what structure a plain text has, and plans that say how to read one.

A text's lines are rows; what a line is depends on the other lines of its text, so all rules are
windows and groupings by text. A text fits in a row, so its lines fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import meetings

# Clocks, labels and limits.
WORD = r"[\p{L}\p{N}]+(?:[.'’\-][\p{L}\p{N}]+)*"
TIME_LABEL = rf"^{WORD}(?: +{WORD})*(?: +\({WORD}(?: +{WORD})*\))?$"
WALL_CLOCK = r"(?:0?[1-9]|1[0-2]):[0-5][0-9](?::[0-5][0-9])?[ \t]*(?:AM|PM|am|pm)|(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?"
HEADER = rf"^(.+?)[ \t]+({WALL_CLOCK})$"
CLOCKISH = r"^(.+?)[ \t]+[0-9]{1,2}:[0-9]{0,2}(?::[0-9]{0,2})?(?:[ \t]*[A-Za-z]{0,2})?$"
ROLE = r"^(?:Speaker(?: +|[0-9])|说话人(?: +|[0-9]))"
CLOCK = r"(?i)^(?:(?:0?[1-9]|1[0-2]):[0-5][0-9](?::[0-5][0-9])?[ \t]*(?:AM|PM)|[0-9]{1,3}:[0-5][0-9](?::[0-5][0-9])?)$"
SPEAKER_LIMIT, TOKEN_LIMIT, ROW_SEPARATORS = 128, 64, (",", ";", "\t", " - ")
#: What runs of values are made of, and marks that say nothing of a layout.
VALUES = r"[\p{L}\p{N}\p{M} \t:.'’\x{2010}\x{2011}\-]+"
PLAIN_MARKS = r"[,;.!?()\s]+"
#: Where a line ends.
LINE_END = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])"


def physical(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line from 1, raw with its line end, bare without it)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = texts.select(F.col(id_col).alias("id"), F.posexplode(F.filter(F.split(text, LINE_END, -1), lambda x: x != "")).alias("pos", "raw"))
    return split.select("id", (F.col("pos") + 1).alias("line"), "raw", F.regexp_replace("raw", r"[\r\n]+$", "").alias("bare"))


def clock_seconds(clock: Column) -> Column:
    """Seconds of a clock of either form; 12 AM is midnight."""
    part = lambda k: F.coalesce(F.get(F.split(F.regexp_replace(clock, "[^0-9:]", ""), ":"), F.lit(k)).try_cast("int"), F.lit(0))
    period = F.upper(F.regexp_extract(clock, r"(?i)(AM|PM)$", 1))
    hour = F.when(period == "", part(0)).otherwise(part(0) % 12 + F.when(period == "PM", 12).otherwise(0))
    return hour * 3600 + part(1) * 60 + part(2)


def _time_label(raw: Column) -> Column:
    """(label, explicit, name, bad) of what stands before a clock: null if it is no label, bad if its brackets are."""
    label = F.regexp_replace(raw, "^ +| +$", "")
    bracketed = label.rlike(r"[\[\]]")
    wrapped = label.rlike(r"^\[[^\[\]]*\]$")
    bare = F.when(wrapped, F.substr(label, F.lit(2), F.length(label) - 2)).otherwise(label)
    role = bare.rlike(ROLE)
    lower = F.exists(F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: w.rlike(r"^\p{Ll}"))
    valid = (bare != "") & (F.length(bare) <= 64) & bare.rlike(r"\p{L}") & bare.rlike(TIME_LABEL) & (role | ~lower)
    name = F.regexp_replace(F.trim(bare), r"\s+", " ")
    made = F.struct(bare.alias("label"), (bracketed | role | bare.endswith(")")).alias("explicit"), name.alias("name"), (bracketed & ~(wrapped & valid)).alias("bad"))
    return F.when(bracketed | valid, made)


def speaker_time(texts: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Texts of headers, a label and a clock, with bodies below: (layouts, records).

    layouts: (id, layout) for every text, speaker-time, plain (one lone header), invalid, or null where
    nothing looks like a header. A label counts as a speaker if it is explicit (in brackets, a role, with a
    parenthesis) or meets itself again. Then every header needs a label that does, a body, and a clock not
    before the last one; nothing half like a header and no line of another layout may be left.
    records: (id, order, clock, speaker, text, source_line) of speaker-time texts.
    """
    lines = physical(texts, id_col, text_col).withColumn("text", F.regexp_replace("bare", r"(?U)^\s+|\s+$", "")).filter("text <> ''")
    control = F.col("text").rlike(r"\p{Cc}")
    heads, halves = F.col("text").rlike(HEADER) & ~control, F.col("text").rlike(CLOCKISH)
    raw = F.when(heads, F.regexp_extract("text", HEADER, 1)).when(halves, F.regexp_extract("text", CLOCKISH, 1))
    lines = lines.withColumn("of", _time_label(raw)).withColumn("clock", F.when(heads, F.regexp_extract("text", HEADER, 2)))
    other = meetings.with_forms(lines.select("id", "line", "text", F.col("bare").rlike(r"\p{Cc}").alias("control"))).select("id", "line", F.col("form").alias("other_form"))
    # a header by its clock whose label is none may still be half a header
    again = F.when(heads & F.col("of").isNull() & halves, _time_label(F.regexp_extract("text", CLOCKISH, 1))).otherwise(F.col("of"))
    lines = lines.withColumn("head", heads & F.col("of").isNotNull()).withColumn("of", again).withColumn("half", ~F.col("head") & F.col("of").isNotNull())
    every = Window.partitionBy("id")
    met = F.count(F.when(F.col("head"), F.lit(1))).over(Window.partitionBy("id", "of.name"))
    lines = lines.withColumn("met", met)
    facts = {
        "bad": F.max(F.coalesce(F.col("of.bad"), F.lit(False))).over(every), "explicit": F.max(F.col("head") & F.col("of.explicit")).over(every), "again": F.max(F.col("head") & (F.col("met") >= 2)).over(every),
        "halves": F.sum(F.col("half").cast("int")).over(every), "explicit_half": F.max(F.col("half") & F.col("of.explicit")).over(every), "candidates": F.sum((F.col("head") | F.col("half")).cast("int")).over(every),
    }
    so_far = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns(facts).join(other, ["id", "line"]).withColumn("nth", F.sum(F.col("head").cast("int")).over(so_far))
    on = F.coalesce(F.col("explicit"), F.lit(False)) | F.coalesce(F.col("again"), F.lit(False))
    order = Window.partitionBy("id").orderBy("line")
    seconds = F.when(F.col("head"), clock_seconds(F.col("clock")))
    late = F.last(seconds, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)) > seconds
    wrong = F.col("half") | (F.col("nth") == 0) | (F.col("head") & ~F.col("of.explicit") & (F.col("met") < 2)) | (~F.col("head") & (F.col("other_form") != "other"))
    wrong = wrong | (F.col("head") & (F.coalesce(F.lead("head").over(order), F.lit(True))))
    lines = lines.withColumn("wrong", F.coalesce(wrong, F.lit(False)) | F.coalesce(late, F.lit(False))).withColumn("on", on)
    any_ = lambda c: F.max(F.coalesce(F.col(c), F.lit(False)))
    found = lines.groupBy("id").agg(any_("bad").alias("bad"), any_("on").alias("on"), any_("wrong").alias("wrong"), any_("explicit_half").alias("explicit_half"), F.max("candidates").alias("candidates"))
    layout = F.when(F.col("bad") | (F.col("on") & F.col("wrong")), "invalid").when(F.col("on"), "speaker-time").when(F.col("explicit_half") | (F.col("candidates") > 1), "invalid").when(F.col("candidates") == 1, "plain")
    layouts = texts.select(F.col(id_col).alias("id")).join(found.select("id", layout.alias("layout")), "id", "left")
    good = lines.join(layouts.filter("layout = 'speaker-time'").select("id"), "id", "left_semi")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line", "bare")))), lambda x: x["bare"]), "\n")
    blocks = good.groupBy("id", "nth").agg(F.max("clock").alias("clock"), F.max(F.when(F.col("head"), F.col("of.label"))).alias("speaker"), body.alias("text"), F.min("line").alias("source_line"))
    return layouts, blocks.select("id", F.col("nth").alias("order"), "clock", "speaker", "text", "source_line")


def speakerish(value: Column) -> Column:
    trimmed = value == F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.coalesce(trimmed & (value != "") & (F.length(value) <= SPEAKER_LIMIT) & value.rlike(r"\p{L}") & ~value.rlike(r"\p{C}"), F.lit(False))


def clockish(value: Column) -> Column:
    return F.coalesce(value.rlike(CLOCK), F.lit(False))


def skeleton(line: Column) -> Column:
    """What is left of a line without its runs of values."""
    return F.regexp_replace(line, VALUES, "")


def structures(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, structure) of every text: plain, unsupported (a regular layout that needs a plan) or invalid (half of one).

    Rows of clock, speaker and words by one separator first; else the one skeleton with marks that
    repeats elects the layout: of all lines, or of headers with bodies between them.
    """
    lines = physical(texts, id_col, text_col).filter(~F.col("bare").rlike(r"(?U)^\s*$"))
    blank = lambda x: x.rlike(r"(?U)^\s*$")
    columns = {}
    for k, separator in enumerate(ROW_SEPARATORS):
        cells = F.split("bare", F.lit(rf"\Q{separator}\E"), -1)
        cell = lambda i, cells=cells: F.get(cells, F.lit(i))
        for c in range(3):
            for s in range(3):
                if s != c:
                    columns[f"r{k}_{c}{s}"] = (F.size(cells) == 3) & clockish(cell(c)) & speakerish(cell(s)) & ~blank(cell(3 - c - s))
        columns[f"r{k}_has"] = F.contains("bare", F.lit(separator))
    shapes = lambda k: [f"r{k}_{c}{s}" for c in range(3) for s in range(3) if c != s]
    each = Window.partitionBy("id").orderBy("line")
    marked = lines.withColumn("skeleton", skeleton(F.col("bare"))).withColumn("marked", (F.regexp_replace("skeleton", PLAIN_MARKS, "") != "") & F.col("bare").rlike(VALUES))
    marked = marked.withColumns(columns).withColumn("at", F.row_number().over(each))
    # the layout's skeleton is elected among those that repeat
    votes = marked.filter("marked").groupBy("id", "skeleton").agg(F.count("*").alias("n")).filter("n >= 2").groupBy("id").agg(F.count("*").alias("n_repeated"), F.min("skeleton").alias("elected"))
    known = marked.join(votes, "id", "left").withColumn("heads", F.coalesce(F.col("skeleton") == F.col("elected"), F.lit(False)))
    gap = F.when(F.col("heads"), F.col("at") - F.last(F.when(F.col("heads"), F.col("at")), ignorenulls=True).over(each.rowsBetween(Window.unboundedPreceding, -1)))
    known = known.withColumn("gap", gap)
    segments = F.min_by(F.regexp_count("bare", F.lit(VALUES)), F.when(F.col("heads"), F.col("at")))
    facts = known.groupBy("id").agg(
        F.count("*").alias("n"), F.max("n_repeated").alias("n_repeated"), F.count_if("heads").alias("n_heads"), F.min(F.when(F.col("heads"), F.col("at"))).alias("first"), F.max(F.when(F.col("heads"), F.col("at"))).alias("last"), F.min("gap").alias("gap"), segments.alias("segments"),
        *[F.every(c).alias(f"all_{c}") for k in range(len(ROW_SEPARATORS)) for c in (*shapes(k), f"r{k}_has")], *[F.max(F.greatest(*shapes(k))).alias(f"any_r{k}") for k in range(len(ROW_SEPARATORS))],
    )
    # separators are tried in turn: rows by an earlier one decide before a later one is looked at
    found = F.when(F.col("n") < 2, "plain")
    for k in range(len(ROW_SEPARATORS)):
        one = F.greatest(*[F.col(f"all_{c}") for c in shapes(k)])
        found = found.when(one, "unsupported").when(F.col(f"any_r{k}") & F.col(f"all_r{k}_has"), "invalid")
    complete = (F.col("first") == 1) & (F.col("last") < F.col("n")) & (F.coalesce("gap", F.lit(2)) > 1)
    found = found.when(F.col("n_repeated").isNull(), "plain").when(F.col("n_repeated") > 1, "invalid").when(F.col("n_heads") == F.col("n"), F.when(F.col("segments") >= 2, "unsupported").otherwise("plain")).when(complete, "unsupported").otherwise("invalid")
    return texts.select(F.col(id_col).alias("id")).join(facts.select("id", found.alias("structure")), "id", "left").select("id", F.coalesce("structure", F.lit("plain")).alias("structure"))


def plan_code(plan: DataFrame, digest: Column) -> Column:
    """Why a plan (source_digest, record_form, blank_lines, prefix, separator, suffix, fields) is refused; null if it is not."""
    token = lambda c: F.coalesce((F.octet_length(c) <= TOKEN_LIMIT) & ~F.replace(F.col(c), F.lit("\t"), F.lit("")).rlike(r"\p{C}"), F.lit(False))
    fields, n = F.col("fields"), F.size("fields")
    header = F.array_join(fields, ",").isin("speaker", "speaker,timestamp", "timestamp,speaker")
    row = F.array_join(F.array_sort(fields), ",").isin("body,speaker", "body,speaker,timestamp")
    forms = F.when(F.col("record_form") == "header_body", header).when(F.col("record_form") == "row", row & (F.col("blank_lines") == "record_separator"))
    blank = F.col("blank_lines").isin("body", "record_separator")
    said = (F.trim("prefix") != "") | (F.trim("suffix") != "") | (F.trim("separator") != "") | (F.col("separator") == "\t")
    shape = blank & forms & token("prefix") & token("separator") & token("suffix") & ~F.contains("prefix", F.lit("\t")) & ~F.contains("suffix", F.lit("\t")) & ((n == 1) | (F.col("separator") != "")) & said
    return F.when(F.coalesce(F.col("source_digest") != digest, F.lit(True)), "SOURCE_DIGEST_MISMATCH").when(~F.coalesce(shape, F.lit(False)), "PLAN_CONTRACT_INVALID")


PLAN = ["source_digest", "record_form", "blank_lines", "prefix", "separator", "suffix", "fields"]


def planned(texts: DataFrame, plans: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Texts read as their plans say: (outcomes, records).

    One parser for all: a line that begins with the prefix, ends with the suffix and has as many parts as the
    plan has fields is a record's head. In row form every line is one; in header_body form lines below are
    its body. Plans are rows (id and PLAN). outcomes: (id, code), code null where the text was read.
    records: (id, order, clock, speaker, text, source_line). A text is read whole or not at all.
    """
    source = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = source.join(plans.select("id", *PLAN), "id")
    both = both.withColumn("code", plan_code(both, F.sha2("text", 256)))
    ready = both.filter("code is null")
    lines = physical(ready, "id", "text").join(ready.select("id", *PLAN), "id")
    bare = F.col("bare")
    size = F.length("bare") - F.length("prefix") - F.length("suffix")
    fits = bare.startswith(F.col("prefix")) & bare.endswith(F.col("suffix")) & (size >= 0)
    middle = F.substr(bare, F.length("prefix") + 1, F.greatest(size, F.lit(0)))
    parts = F.when(F.size("fields") > 1, F.split(middle, F.concat(F.lit("\\Q"), F.col("separator"), F.lit("\\E")), -1)).otherwise(F.array(middle))
    parts = F.when(fits & (F.size(parts) == F.size("fields")), parts)
    lines = lines.withColumn("parts", parts).withColumn("row_form", F.col("record_form") == "row")
    value = lambda name: F.get("parts", (F.array_position("fields", F.lit(name)) - 1).cast("int"))
    lines = lines.withColumns({"speaker": F.when(F.col("parts").isNotNull(), value("speaker")), "clock": F.when(F.col("parts").isNotNull() & F.array_contains("fields", F.lit("timestamp")), F.nullif(value("timestamp"), F.lit(""))), "said": F.when(F.col("row_form") & F.col("parts").isNotNull(), value("body"))})
    order = Window.partitionBy("id").orderBy("line")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head, empty = F.col("parts").isNotNull(), bare == ""
    # in row form an empty line stands between two records alone
    stray = F.col("row_form") & ((empty & (F.coalesce(F.lag("bare").over(order), F.lit("")) == "")) | (empty & F.lead("bare").over(order).isNull()) | (~empty & ~head))
    lines = lines.withColumn("nth", F.sum(head.cast("int")).over(so_far)).withColumn("stray", stray)
    below = F.array_sort(F.collect_list(F.when(~F.col("row_form") & F.col("parts").isNull(), F.struct("line", "raw", "bare"))))
    records = lines.filter(~(F.col("row_form") & empty)).groupBy("id", "nth").agg(
        F.min_by("speaker", "line").alias("speaker"), F.min_by("clock", "line").alias("clock"), F.max("said").alias("said"), F.min("line").alias("source_line"), below.alias("below"), F.max("stray").alias("stray"), F.any_value("row_form").alias("row_form"), F.any_value("blank_lines").alias("blank_lines"))
    # trailing empty lines part records, others are an error, where the plan says so
    parting = F.col("blank_lines") == "record_separator"
    last = F.array_max(F.transform(F.filter("below", lambda x: x["bare"] != ""), lambda x: x["line"]))
    kept = F.when(parting, F.filter("below", lambda x: x["line"] <= last)).otherwise(F.col("below"))
    records = records.withColumn("kept", F.coalesce(kept, F.array().cast("array<struct<line:int,raw:string,bare:string>>")))
    inner = parting & F.exists("kept", lambda x: x["bare"] == "")
    body = F.when(F.col("row_form"), F.col("said")).otherwise(F.regexp_replace(F.array_join(F.transform("kept", lambda x: x["raw"]), ""), r"(?:\r\n|\r|\n)\z", ""))
    records = records.withColumn("text", body)
    untold = F.coalesce(F.col("text").rlike(r"(?U)^\s*$") | F.col("text").rlike(r"[\p{Cc}&&[^\r\n\t]]"), F.lit(True))
    odd_clock = F.col("clock").isNotNull() & ~clockish(F.col("clock"))
    wrong = F.col("stray") | inner | (F.col("nth") == 0) | ~speakerish(F.col("speaker")) | untold | odd_clock
    by = Window.partitionBy("id").orderBy("nth")
    seconds = F.when(~odd_clock, clock_seconds(F.col("clock")))
    late = F.last(seconds, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)) > seconds
    records = records.withColumn("wrong", F.coalesce(wrong, F.lit(True)) | F.coalesce(late, F.lit(False)))
    # a stray empty line is in no record of its own
    strays = lines.groupBy("id").agg(F.max("stray").alias("stray"))
    judged = records.groupBy("id").agg((F.max("wrong") | (F.count("*") < 2)).alias("wrong")).join(strays, "id")
    bad = both.select("id", "code").join(judged.select("id", (F.col("wrong") | F.coalesce("stray", F.lit(False))).alias("wrong")), "id", "left")
    outcomes = bad.select("id", F.coalesce("code", F.when(F.coalesce("wrong", F.lit(True)), "SOURCE_LAYOUT_MISMATCH")).alias("code"))
    good = records.join(outcomes.filter("code is null").select("id"), "id", "left_semi")
    return outcomes, good.select("id", F.col("nth").alias("order"), "clock", "speaker", "text", "source_line")


def formats(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, format) of every text: speaker-time, invalid, timestamped, speaker-labeled, plain or empty. Blocks of speaker and time are tried first."""
    blocks, _ = speaker_time(texts, id_col, text_col)
    others = meetings.formats(meetings.with_forms(meetings.lines_of(texts, id_col, text_col)))
    return blocks.join(others, "id", "left").select("id", F.coalesce("layout", "format", F.lit("empty")).alias("format"))


def records(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, order, format, clock, speaker, text, source_line) of every text that can be read; an invalid one has none."""
    blocks, timed = speaker_time(texts, id_col, text_col)
    lines = meetings.with_forms(meetings.lines_of(texts, id_col, text_col)).join(blocks, "id").filter("layout is null or layout = 'plain'")
    # a lone header is a line of a plain text, whatever other forms its lines have
    plain = F.col("layout").isNotNull()
    lines = lines.withColumns({c: F.when(~plain, F.col(c)) for c in ("clock", "speaker")} | {"form": F.when(plain, "other").otherwise(F.col("form")), "body": F.when(plain, F.col("text")).otherwise(F.col("body"))}).drop("layout")
    columns = ["id", "order", "format", "clock", "speaker", "text", "source_line"]
    return meetings.records(lines).select(columns).unionByName(timed.withColumn("format", F.lit("speaker-time")).select(columns))
