"""Meeting text: which layout a text has, and its lines as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The forms of lines, and words that are labels of metadata, not of speakers.
TIMESTAMPED = r"^(\d{1,3}:\d{2})Speaker\s+([A-Z])\s*(.*)$"
LABELLED = r"^(?:\[(\d{1,3}:\d{2}(?::\d{2})?)\] *)?([^:：]+?)[:：] *(\S.*)$"
LABEL = r"^[\p{L}\p{N}]+(?:[.'’-][\p{L}\p{N}]+)*(?: +[\p{L}\p{N}]+(?:[.'’-][\p{L}\p{N}]+)*)*$"
NOT_SPEAKERS = [
    "agenda", "answer", "author", "created", "date", "description", "duration", "file", "id", "key", "language", "location", "meeting id", "meeting title", "metadata", "name", "note", "owner", "path", "project",
    "project id", "question", "schema", "source", "speaker", "status", "summary", "time", "title", "todo", "topic", "type", "updated", "uri", "url", "value", "version", "warning",
]
NOT_FIRST = ["action", "chapter", "meeting", "phase", "project", "section", "step"]
ROLES = ("Speaker", "说话人")


def lines_of(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line from 1, text, control) of the lines that are not blank, trimmed; control tells of control characters anywhere in the line."""
    split = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r\n|\r|\n")).alias("pos", "text"))
    return split.select("id", (F.col("pos") + 1).alias("line"), F.trim("text").alias("text"), F.col("text").rlike(r"\p{Cc}").alias("control")).filter("text <> ''")


def speaker_label(label: Column) -> Column:
    """Whether a label can be a speaker's: short, of words with a letter, capitalised, and none of metadata."""
    words = F.split(label, " +")
    lower = F.exists(words, lambda w: w.rlike(r"^\p{Ll}"))
    role = label.startswith(ROLES[0]) | label.startswith(ROLES[1])
    named = ~F.lower(label).isin(NOT_SPEAKERS) & ~F.lower(F.element_at(words, 1)).isin(NOT_FIRST)
    return (F.length(label) <= 24) & label.rlike(LABEL) & label.rlike(r"\p{L}") & named & (~lower | role)


def with_forms(lines: DataFrame) -> DataFrame:
    """Adds what each line is: form (timestamped, labelled, other), clock, speaker and body. A line with control characters is no speaker's."""
    label = F.trim(F.regexp_extract("text", LABELLED, 2))
    body = F.regexp_extract("text", LABELLED, 3)
    odd_body = body.rlike(r"^[/\\]") | F.element_at(F.split(body, " "), 1).rlike("[:：]")
    stamped = F.col("text").rlike(TIMESTAMPED)
    spoken = F.col("text").rlike(LABELLED) & speaker_label(label) & ~odd_body & ~F.col("control")
    pick = lambda a, b: F.when(stamped, F.nullif(a, F.lit(""))).when(spoken, F.nullif(b, F.lit("")))
    return lines.select(
        "*",
        F.when(stamped, "timestamped").when(spoken, "labelled").otherwise("other").alias("form"),
        pick(F.regexp_extract("text", TIMESTAMPED, 1), F.regexp_extract("text", LABELLED, 1)).alias("clock"),
        pick(F.regexp_extract("text", TIMESTAMPED, 2), label).alias("speaker"),
        F.when(stamped, F.trim(F.regexp_extract("text", TIMESTAMPED, 3))).when(spoken, F.trim(body)).otherwise(F.col("text")).alias("body"),
    )


def formats(lines: DataFrame) -> DataFrame:
    """(id, format) of texts with lines: timestamped, speaker-labeled or plain, by how many lines have the form."""
    n, stamped, spoken = F.count("*"), F.count_if(F.col("form") == "timestamped"), F.count_if(F.col("form") == "labelled")
    half = F.floor(n / 2)
    found = F.when(stamped >= F.greatest(F.lit(1), half), "timestamped").when(((n == 1) & (spoken == 1)) | (spoken >= F.greatest(F.lit(2), half)), "speaker-labeled")
    return lines.groupBy("id").agg(found.otherwise("plain").alias("format"))


def records(lines: DataFrame) -> DataFrame:
    """(id, order, format, clock, speaker, text, source_line): a line of the format's form begins a record, others continue it.

    Lines before the first record of a timestamped text belong to none; in a labelled text they
    are one record without speaker. In a plain text every line is a record.
    """
    known = lines.join(formats(lines), "id")
    begins = (F.col("format") == "plain") | ((F.col("format") == "timestamped") & (F.col("form") == "timestamped")) | ((F.col("format") == "speaker-labeled") & (F.col("form") == "labelled"))
    so_far = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = known.withColumn("begins", begins).withColumn("nth", F.sum(F.col("begins").cast("int")).over(so_far))
    known = known.filter((F.col("nth") > 0) | (F.col("format") == "speaker-labeled"))
    first = lambda c: F.min_by(F.when(F.col("begins"), F.col(c)), "line")
    said = F.when(F.col("begins") & (F.col("format") != "plain"), F.col("body")).otherwise(F.col("text"))
    packed = known.groupBy("id", "nth", "format").agg(first("clock").alias("clock"), first("speaker").alias("speaker"), F.min("line").alias("source_line"), F.array_sort(F.collect_list(F.struct("line", said.alias("said")))).alias("all"))
    order = F.row_number().over(Window.partitionBy("id").orderBy("nth")).alias("order")
    plain = F.col("format") == "plain"
    return packed.select(
        "id", order, "format", F.when(~plain, F.col("clock")).alias("clock"), F.when(~plain, F.col("speaker")).alias("speaker"),
        F.when(plain, F.col("all")[0]["said"]).otherwise(F.array_join(F.transform("all", lambda x: x["said"]), " ")).alias("text"), "source_line",
    )
