"""Reading raw logs and exports, and publishing tables so that readers see all of a version or none."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line from 1, raw) of text files. Files may be split over tasks; blank lines count as lines.

    Lines are counted within the blocks that a file is read in, then blocks within their file, so that no
    file meets in one task.
    """
    rows = spark.read.text(path, pathGlobFilter="*").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("raw"))
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("nth"))
    return rows.withColumn("own", own).join(sizes, ["file", "block"]).select("file", (F.col("own") + F.col("before")).cast("int").alias("line"), "raw")


def parsed(lines: DataFrame, schema: str, expected: str) -> tuple[DataFrame, DataFrame]:
    """Lines that are objects of the expected schema (file, line, e), and the lines refused; blank lines are neither."""
    filled = lines.filter(F.trim("raw") != "").withColumn("e", F.from_json("raw", schema))
    good = F.coalesce(F.trim("raw").startswith("{") & (F.col("e.schema") == expected), F.lit(False))
    return filled.filter(good).drop("raw"), filled.filter(~good).drop("e")


def unexpected_folders(index: DataFrame, found: DataFrame) -> DataFrame:
    """(folder, code) of folders that the index names and are not there, or that are there and not named."""
    both = index.select("folder").distinct().withColumn("named", F.lit(True)).join(found.select("folder").distinct().withColumn("there", F.lit(True)), "folder", "full_outer")
    return both.filter("named is null or there is null").select("folder", F.when(F.col("there").isNull(), "missing").otherwise("extra").alias("code"))


def content_digest(df: DataFrame) -> str:
    """A name for the rows of a table, whatever their order: the number of rows and two sums of their hashes."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    n, a, b = df.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")) for seed in (1, 2)]).first()
    return f"{n}_{a or 0}_{b or 0}".replace("-", "m")


def _named(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.parquet(path).first()
    except AnalysisException:
        return None
    return row["digest"] if row else None


def publish(df: DataFrame, path: str) -> str:
    """Publish a table once. The same rows again change nothing; other rows are refused. Returns the digest.

    The rows are written under their digest first and named last, so a job that fails leaves nothing published.
    """
    spark, digest = df.sparkSession, content_digest(df)
    there = _named(spark, f"{path}/manifest")
    if there is not None:
        if there != digest:
            raise ValueError(f"{path} is published with other rows")
        return digest
    df.write.mode("overwrite").parquet(f"{path}/data-{digest}")
    spark.createDataFrame([(digest,)], "digest string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return digest


def replace_all(tables: dict[str, DataFrame], path: str, tries: int = 10) -> str:
    """Replace a set of tables as one version, whatever the version before; a reader finds the old one or the new one. The same content keeps the version."""
    from quarry.sources.versions import Versions

    kept = Versions(next(iter(tables.values())).sparkSession, path)
    for _ in range(tries):
        if kept.save(tables, kept.current()[0])["ok"]:
            said = kept.current()[1]
            return "-".join(said["digests"][k] for k in sorted(said["digests"]))
    raise RuntimeError(f"{path} is being replaced by others")


def published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data-{_named(spark, f'{path}/manifest')}")


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    from quarry.sources.versions import Versions

    return Versions(spark, path).read(name)
