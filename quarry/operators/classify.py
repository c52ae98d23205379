"""Which items are source, which are conversation, and what a review may read of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import generic_marker
from quarry.sources.items import mapped

#: Roles that speak, and the label of what does not.
USERS, ASSISTANTS = ("human", "speaker", "user"), ("ai", "assistant", "agent", "model")
LABELS = {"tool_call": "[tool call]", "tool_result": "[tool result]", "artifact": "[artifact]"}


def disposition(event_type: Column, actor_type: Column, role: Column, text: Column) -> Column:
    """The first rule that fits an item without artifacts' creators (see with_artifacts)."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    human = F.coalesce(actor_type.isin(*USERS), F.lit(False))
    return (
        F.when(event_type == "tool_call", "drop_tool_call")
        .when(event_type == "tool_result", "drop_tool_result")
        .when(event_type == "git", "drop_execution_observation")
        .when((event_type == "agent") & blank, "drop_agent_plumbing")
        .when((event_type == "agent") & generic_marker(text), "drop_generic_execution_marker")
        .when(event_type == "agent", "keep_meaningful_progress")
        .when(event_type == "system", "drop_system_machinery")
        .when(event_type == "artifact", "drop_machine_artifact")
        .when(blank, "drop_ambiguous")
        .when(generic_marker(text) & ~human, "drop_generic_execution_marker")
        .when(event_type.isin("progress", "status"), "keep_meaningful_progress")
        .when(event_type.isin("message", "record", "speech") & human, "keep_human_dialogue")
        .when(event_type.isin("message", "record", "speech") & actor_type.isin("ai", "assistant", "agent") & F.coalesce(role, F.lit("")).isin("", "assistant"), "keep_agent_dialogue")
        .otherwise("drop_ambiguous")
    )


def classified(items: DataFrame) -> DataFrame:
    found = disposition(F.col("event_type"), F.col("actor_type"), F.col("role"), F.col("content"))
    return items.withColumn("disposition", found).withColumn("kept", F.col("disposition").startswith("keep_"))


def with_artifacts(items: DataFrame) -> DataFrame:
    """Second pass: an attachment or image is source if the item that made it is kept.

    Needs item_id, kind, created_by, disposition and kept.
    """
    makers = items.filter("kept").select(F.col("item_id").alias("created_by")).distinct()
    mine = items.filter((F.col("event_type") == "artifact") & F.lower("kind").isin("attachment", "image"))
    source = mine.join(makers, "created_by", "left_semi").select("item_id", F.lit(True).alias("__source"))
    out = items.join(source, "item_id", "left")
    out = out.withColumn("disposition", F.when(F.col("__source"), "keep_human_source").otherwise(F.col("disposition")))
    return out.withColumn("kept", F.col("kept") | F.coalesce("__source", F.lit(False))).drop("__source")


def speaker(role: Column, actor_type: Column) -> Column:
    said = F.lower(F.coalesce(F.nullif(role, F.lit("")), actor_type))
    return F.when(said.isin(*USERS), "user").when(said.isin(*ASSISTANTS), "assistant")


def reviewed(items: DataFrame) -> DataFrame:
    """What a privacy review reads: conversation in full, of all else a fixed label."""
    who = speaker(F.col("role"), F.col("actor_type"))
    talks = (F.col("event_type") == "message") & who.isNotNull() & (F.trim(F.coalesce("content", F.lit(""))) != "")
    label = mapped(F.col("event_type"), LABELS, F.lit("[action]"))
    return items.select(
        "document_id", "sequence", "item_id",
        F.when(talks, "message").otherwise("action_label").alias("review_type"),
        F.when(talks, who).alias("speaker"),
        F.when(talks, F.col("content")).otherwise(label).alias("review_text"),
    )


def coverage_share(items: DataFrame) -> DataFrame:
    """Items and characters by review type, and their share of all: what a review would read."""
    found = reviewed(items).groupBy("review_type").agg(F.count("*").alias("events"), F.sum(F.length("review_text")).cast("long").alias("chars"))
    total = found.agg(F.sum("chars").alias("all_chars"))
    out = found.crossJoin(F.broadcast(total))  # one row
    return out.select("review_type", "events", "chars", F.round(F.col("chars") / F.col("all_chars"), 9).alias("share"), (F.col("review_type") == "message").alias("reviewed"))
