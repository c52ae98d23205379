"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of m shingles lies in a document when at least ``threshold`` of its shingles
do. At most floor((1 - threshold) * m) may then be missing, so of the item's
floor((1 - threshold) * m) + 1 smallest hashes one must be in the document: that bottom-k
sketch misses nothing, however long the document. Items are partitioned by size; each
partition has its own sketch bound, and only document hashes under the bounds are looked
up. Candidates are verified by exact containment of all shingles.

Words are runs of letters and digits of the lower-cased text, shingles are ``width`` words;
an item of fewer words is one shingle of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small, text_of, written

def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column, widths: list[int]) -> Column:
    """Hashes of all shingles of the given widths, with repeats. The array is bound once, not per shingle."""

    def of(ws: Column, w: int) -> Column:
        all_starts = F.sequence(F.lit(1), F.size(ws) - (w - 1))
        return F.when(F.size(ws) >= w, F.transform(all_starts, lambda i: F.xxhash64(F.slice(ws, i, w)))).otherwise(F.array().cast("array<bigint>"))

    def all_of(ws: Column) -> Column:
        return F.concat(*[of(ws, w) for w in widths])

    return F.get(F.transform(F.array(words), all_of), F.lit(0))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), text_of(text_col))


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """(key, doc_id, item_id, n_shingles, n_matched, containment) for every item that a document holds.

    ``key`` tells rows apart by id and text; repeated rows give one. n_shingles counts the
    item's distinct shingles. Null and empty texts, and items without words, match nothing;
    items with equal text each match. Other columns are not read.
    """
    words = items.select(F.col(item_col).alias("item_id"), words_of(text_of(item_text)).alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("width", F.least(F.size("words"), F.lit(width)))
    by_width = [shingle_hashes(F.col("words"), [w]) for w in range(1, width + 1)]
    item_sets = words.select("item_id", "width", F.array_distinct(F.get(F.array(*by_width), F.col("width") - 1)).alias("shingles"))
    item_sets = written(item_sets.withColumn("n_shingles", F.size("shingles")), "items")
    widths = sorted(r["width"] for r in item_sets.select("width").distinct().collect()) or [width]

    # a partition of sizes: its sketches, and the bound under which its hashes lie
    missing = F.floor(F.col("n_shingles") * (1 - threshold) + 1e-9).cast("int")
    sketches = item_sets.select(
        "item_id",
        F.floor(F.log2("n_shingles")).alias("part"),
        (F.col("n_shingles") - missing).alias("needed"),
        F.explode(F.slice(F.array_sort("shingles"), F.lit(1), missing + 1)).alias("hash"),
    )
    bounds = {r["part"]: (r["bound"], r["needed"]) for r in sketches.groupBy("part").agg(F.max("hash").alias("bound"), F.min("needed").alias("needed")).collect()}

    rows = docs.select(F.col(id_col).alias("doc_id"), keyed(docs, id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    hashed = rows.select("key", shingle_hashes(words_of(F.col("text")), widths).alias("hashes"))
    # a document shorter than a partition's items cannot hold them; the rest meet its bound
    bound = F.greatest(*[F.when(F.size("hashes") >= needed, F.lit(b)) for b, needed in bounds.values()], F.lit(-(2**63)), F.lit(-(2**63)))
    probes = hashed.withColumn("bound", bound)
    probes = probes.select("key", F.explode(F.filter("hashes", lambda h: h <= F.col("bound"))).alias("hash"))
    found = probes.join(small(sketches.select("item_id", "hash")), "hash").select("key", "item_id").distinct()
    found = written(found, "candidates")

    texts = rows.join(small(found), "key")
    pairs = texts.join(small(item_sets.select("item_id", "shingles", "n_shingles")), "item_id")
    matched = F.size(F.array_intersect("shingles", shingle_hashes(words_of(F.col("text")), widths))).cast("long")
    pairs = pairs.select("key", "doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), matched.alias("n_matched"))
    held = pairs.filter(F.col("n_matched") >= F.ceil(F.col("n_shingles") * threshold - 1e-9)).distinct()
    return held.withColumn("containment", F.round(F.col("n_matched") / F.col("n_shingles"), 6))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no item, all columns; null and empty texts stay, repeated rows share a fate."""
    bad = written(contained_items(docs, items, id_col, text_col, **options).select(F.col("key").alias("__key")).distinct(), "contaminated")
    # rows as one value, so that no column of theirs can clash
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), keyed(docs, id_col, text_col).alias("__key"))
    return rows.join(small(bad), "__key", "left_anti").select("row.*")
