"""Named queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import corpus, edits, evidence, handover, minutes, packaged, privacy, receipted, redaction, relations, release, review, sharding, told

MODULES = (corpus, edits, evidence, handover, minutes, packaged, privacy, receipted, redaction, relations, release, review, sharding, told)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
