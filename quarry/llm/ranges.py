"""Groups of any size: rows laid out in ranges, and joins whose heavy keys are broadcast.

A group that holds a third of all rows must not meet in one task. Laid out by (group, order)
it lies in several ranges; windows and joins then run per (range, group), and what they need of
other ranges is a table of the groups that lie in more than one, of which a range has two at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, partitions, small, written


def laid_out(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """The rows in ranges of (group, order), written; ``part`` numbers the ranges. Equal rows may lie in two ranges."""
    row = F.monotonically_increasing_id()
    ranged = df.withColumn("__row", row).repartitionByRange(partitions(df.sparkSession), *group, *order, "__row")
    return written(ranged.withColumn("part", F.spark_partition_id()).drop("__row"), name)


def across(totals: DataFrame, group: list[str]) -> DataFrame:
    """Of one row per (part, group), those of groups in several parts: at most two rows a part."""
    return totals.withColumn("__parts", F.count("*").over(Window.partitionBy(*group))).filter("__parts > 1").drop("__parts")


def with_totals(df: DataFrame, totals: DataFrame, key: str, rows: str) -> DataFrame:
    """Left join of ``df`` with one row per key, written, that says how many rows of ``df`` have it.

    Null keys meet null keys. Where the totals are too many to broadcast, keys of more than a
    millionth of all rows are broadcast, which are at most a million, and the rest, now even, shuffles.
    """
    same = df[key].eqNullSafe(totals[key])
    joined = lambda left, right: left.join(right, left[key].eqNullSafe(right[key]), "left").drop(right[key])
    if totals.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(totals), same, "left").drop(totals[key])
    every = totals.agg(F.sum(rows)).first()[0]
    heavy = totals.filter(F.col(rows) > every / BROADCAST_ROWS)
    light = totals.filter(F.col(rows) <= every / BROADCAST_ROWS)
    named = F.broadcast(heavy.select(F.col(key).alias("__key")))
    is_heavy = df[key].eqNullSafe(F.col("__key"))
    return joined(df.join(named, is_heavy, "left_semi"), F.broadcast(heavy)).unionByName(joined(df.join(named, is_heavy, "left_anti"), light))


__all__ = ["across", "laid_out", "small", "with_totals"]
