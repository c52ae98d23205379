"""Exact dedup through a persistent digest index.

The index is a table partitioned by batch, bucketed and sorted by digest. A batch is reduced
to one row per digest before any join, digests that other batches brought are found by a
sort-merge join against the index, the unknown ones by an anti-join, and these become the
batch's partition. Text never leaves the scan. Digests of a batch are written once, so that a
lost executor costs no second hashing.

A batch is named by its content unless the caller names it. Its partition is overwritten as
one, and its own digests never count as known: a batch that is run again, after a failure at
any point, gives the rows it gave or would have given.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, partitions, text_of, work_path, written


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, row (tells repeated rows apart) and the digest of the normalised text."""
    normal = F.regexp_replace(text_of(text_col), SPACE, " ")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.sha2(F.encode(normal, "UTF-8"), 256).alias("text_sha256"),
    )


class DigestIndex:
    """A table (text_sha256, keep_id, keep_row, batch), bucketed and sorted by text_sha256.

    With ``path``, a folder that all executors share, the table lies there and is found again by
    later sessions; without, the catalogue owns it, in the warehouse. One writer at a time: of two batches added at once each may keep a
    text that both hold.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int, path: str | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        at = f"LOCATION '{path}'" if path else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (text_sha256 STRING, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS {at}"
        )
        if path:
            # an empty partition makes sure that the folder is there
            spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch = 'none') SELECT '', 0L, 0L WHERE false")
            spark.catalog.recoverPartitions(name)

    def known(self, batch: str) -> DataFrame:
        """One row per digest of the other batches: (text_sha256, keep_id, keep_row, batch); of equal ones the first batch by name."""
        other = self.spark.table(self.name).filter(F.col("batch") != batch)
        return other.groupBy("text_sha256").agg(F.min(F.struct("batch", "keep_id", "keep_row")).alias("of")).select("text_sha256", "of.keep_id", "of.keep_row", "of.batch")

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Add a batch of written rows (doc_id, row, text_sha256); one written row per digest of the batch.

        Returns text_sha256, group_size (rows of the batch), and keep_id, keep_row and batch of the row that stays.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"a batch's name has letters, digits, _, . and - only: {batch!r}")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
        groups = rows.groupBy("text_sha256").agg(first.alias("first"), F.count("*").alias("group_size"))
        groups = written(groups.select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "digest-groups")
        known = self.known(batch)
        fresh = groups.drop("group_size").hint("merge").join(known.select("text_sha256"), "text_sha256", "left_anti")
        # written apart: a table that is read can't be overwritten
        fresh = written(fresh.select("text_sha256", "keep_id", "keep_row"), "digests-fresh")
        fresh.repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256").createOrReplaceTempView("quarry_fresh_digests")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT text_sha256, keep_id, keep_row FROM quarry_fresh_digests")
        self.spark.catalog.dropTempView("quarry_fresh_digests")
        met = groups.hint("merge").join(known.select("text_sha256", *[F.col(c).alias(f"known_{c}") for c in ("keep_id", "keep_row", "batch")]), "text_sha256", "left")
        held = F.col("known_batch").isNotNull()
        stays = {c: F.when(held, F.col(f"known_{c}")).otherwise(own).alias(c) for c, own in (("keep_id", F.col("keep_id")), ("keep_row", F.col("keep_row")), ("batch", F.lit(batch)))}
        return written(met.select("text_sha256", "group_size", *stays.values()), "digest-verdicts")

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate a batch against the index and itself; add what is new.

        Returns doc_id, keep_id, group_size, kept, text_sha256 for every row of the batch.
        Null text is empty text. Of rows with equal text the smallest doc_id stays (null
        last); of rows that share that doc_id too, one. group_size counts the batch.
        A text that another batch brought keeps that batch's keep_id and drops all rows
        here. The same batch again gives the same rows. An empty batch gives no rows. Other
        columns are not read.
        """
        rows = written(digested(docs, id_col, text_col), "digests")
        batch = batch or _content(rows)
        verdict = self.add(rows, batch)
        ours = (F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))
        return rows.join(verdict, "text_sha256").select("doc_id", "keep_id", "group_size", ours.alias("kept"), "text_sha256")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _content(rows: DataFrame) -> str:
    """A name made of the batch's rows, in whatever order they come."""
    of = F.xxhash64("doc_id", "text_sha256").cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.sum(of)).first()
    return f"{n}-{total or 0}"


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """All rows against an index of their own, loaded in ``batches`` by ranges of doc_id.

    The result is that of one batch: earlier batches hold the smaller ids, so the row that
    stays is the one of the smallest doc_id of all, and group_size counts all rows. Ranges
    are cut at approximate quantiles of doc_id; a repeated id is never cut, null ids come last.
    """
    spark = docs.sparkSession
    rows = written(digested(docs, id_col, text_col), "digests")
    cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    part = sum(((F.col("doc_id") > c).cast("int") for c in cuts), F.lit(0))
    part = F.coalesce(part, F.lit(len(cuts)))
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", partitions(spark), work_path(spark, "digest-index"))
    try:
        verdicts = [index.add(rows.filter(part == k), f"part-{k:04}") for k in range(len(cuts) + 1)]
    finally:
        index.drop()
    if len(verdicts) == 1:
        verdict = verdicts[0]
    else:
        # one row per digest and batch at most: the batch that keeps it is the same in all
        every = verdicts[0]
        for v in verdicts[1:]:
            every = every.unionByName(v)
        keeps = F.first(F.struct("keep_id", "keep_row")).alias("of")
        verdict = written(every.groupBy("text_sha256").agg(keeps, F.sum("group_size").alias("group_size")).select("text_sha256", "of.*", "group_size"), "digest-verdicts")
    return rows.join(verdict, "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
