"""The item model over the tables at hand: one row per turn or action, grouped in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The item type of each recorded event type; others are left as they are named.
EVENT_TYPES = {"view": "tool_call", "click": "tool_call", "error": "tool_result", "signup": "system", "purchase": "artifact"}
ACTORS = {"user": "human", "assistant": "ai", "system": "system"}


def mapped(column: Column, values: dict[str, str], otherwise: Column | None = None) -> Column:
    """A lookup among few fixed values, as one CASE."""
    out = None
    for k, v in values.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(otherwise if otherwise is not None else column)


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as items: document_id, sequence (from 1), item_id, event_type, actor_type, role, content."""
    role = F.lower("role")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), "conv_id").alias("document_id"),
        (F.col("turn") + 1).alias("sequence"),
        F.concat(F.lit("conv-"), "conv_id", F.lit(":turn-"), "turn").alias("item_id"),
        F.lit("message").alias("event_type"),
        mapped(role, ACTORS).alias("actor_type"),
        role.alias("role"),
        F.col("text").alias("content"),
    )


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded events as items; the properties are the content. No window: the id keeps the order."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), "user_id").alias("document_id"),
        F.col("event_id").alias("sequence"),
        F.concat(F.lit("event-"), "event_id").alias("item_id"),
        mapped(F.col("event_type"), EVENT_TYPES).alias("event_type"),
        F.lit("tool").alias("actor_type"),
        F.lit(None).cast("string").alias("role"),
        F.col("props").alias("content"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_items(spark, sf_dir).unionByName(event_items(spark, sf_dir))
