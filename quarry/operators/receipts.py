"""Receipts of what was read: digests of turns, combined in trees, and the way down to a changed one.

A turn's digest goes into a block of FAN successive places, a block's digest into one of FAN
blocks, and so on to its document; documents go by the first digits of the digest of their name
into the corpus. Every grouping meets FAN digests or so at once, never a document's or the
corpus's turns, and each level is a 256th of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import records as rec
from quarry.sources.work import written

#: Places of a block. Digits of a name by which documents part are two a level.
FAN = 256
#: The kinds of documents that are dialogue.
KINDS = ("trajectory", "meeting")


def _joined(order: Column, line: Column) -> Column:
    """The digest of the lines in order."""
    return rec.digest(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("x")))), lambda s: s["x"]), "\n"))


def turn_authorities(turns: DataFrame) -> DataFrame:
    """Each turn with n_bytes, n_chars, leaf (the digest of what is bound) and code, its first fault or null.

    turns: document_id, document_kind, event_id, item_id, sequence, role, timestamp, text.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    code = (
        F.when(blank("event_id") | blank("item_id"), "identity_missing")
        .when(F.col("event_id") != F.col("item_id"), "identity_not_canonical")
        .when(F.coalesce(F.col("sequence") < 1, F.lit(True)), "sequence_invalid")
        .when(blank("text"), "text_missing")
        .when(~F.coalesce(F.col("document_kind").isin(*KINDS), F.lit(False)), "kind_invalid")
    )
    text = F.coalesce("text", F.lit(""))
    n_bytes = F.octet_length(text).cast("long")
    bound = rec.canonical(eventId="event_id", itemId="item_id", sequence="sequence", role="role", timestamp="timestamp", textByteLength=n_bytes, textDigest=rec.digest(text))
    return turns.withColumns({"n_bytes": n_bytes, "n_chars": F.length(text).cast("long"), "leaf": rec.digest(bound), "code": code})


def _furthest(turns: DataFrame) -> int:
    return max(abs(x or 0) for x in turns.agg(F.max("sequence"), F.min("sequence")).first())


def document_tree(turns: DataFrame, fan: int = FAN, furthest: int | None = None) -> DataFrame:
    """(document_id, level, node, digest) of turns with leaf and sequence: level 0 are the turns by place, the top level has node 0 alone.

    Trees are as high as the furthest place wants, by default that of these turns.
    """
    most = _furthest(turns) if furthest is None else furthest
    # turns of one place, a fault, may be any number: they are added up, not collected
    lanes = [F.sum(F.xxhash64("leaf", F.lit(k)).cast("decimal(38,0)")) for k in range(2)]
    digest = F.when(F.count("*") == 1, F.min("leaf")).otherwise(rec.digest(F.concat_ws(" ", F.count("*"), *lanes)))
    level = turns.groupBy("document_id", F.lit(0).alias("level"), F.coalesce("sequence", F.lit(0)).cast("long").alias("node")).agg(digest.alias("digest"))
    every, k = level, 0
    while most > 0 or k == 0:
        k, most = k + 1, most // fan
        up = F.floor(F.col("node") / fan).cast("long")
        level = level.groupBy("document_id", F.lit(k).alias("level"), up.alias("up")).agg(_joined(F.col("node"), F.col("digest")).alias("digest")).withColumnRenamed("up", "node")
        every = every.unionByName(level)
    return every


def receipts(turns: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per document: n_turns, n_bytes, n_chars, digest and code, the first of its faults by name or null.

    A repeated item of a document is item_repeated, of two documents item_shared.
    """
    known = turn_authorities(turns)
    tree = document_tree(known, fan)
    top = tree.groupBy("document_id").agg(F.max_by("digest", "level").alias("digest"))
    shared = known.groupBy("item_id").agg(F.count("*").alias("n"), F.min("document_id").alias("low"), F.max("document_id").alias("high")).filter("n > 1")
    twice = F.when(F.col("low") == F.col("high"), "item_repeated").otherwise("item_shared")
    # one row a document that has such an item
    odd = known.join(shared, "item_id").groupBy("document_id").agg(F.min(twice).alias("odd"))
    facts = known.groupBy("document_id").agg(F.count("*").alias("n_turns"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_chars").alias("n_chars"), F.min("code").alias("code"))
    joined = facts.join(top, "document_id").join(odd, "document_id", "left")
    return joined.select("document_id", "n_turns", "n_bytes", "n_chars", "digest", F.coalesce("code", "odd").alias("code"))


def corpus_tree(documents: DataFrame) -> DataFrame:
    """(level, node, digest, n_documents) of receipts: nodes are the first digits of the digest of the document's name, the root has none."""
    named = documents.select(rec.digest(F.col("document_id")).alias("name"), rec.digest(rec.canonical(documentId="document_id", nTurns="n_turns", nBytes="n_bytes", digest="digest")).alias("digest"))
    n = named.count()
    digits = 2
    while n > FAN * 16**digits:
        digits += 2
    level = named.select(F.substring("name", 1, digits).alias("node"), F.col("name").alias("below"), "digest", F.lit(1).cast("long").alias("n_documents"))
    every, depth = None, digits
    while True:
        level = level.groupBy("node").agg(_joined(F.col("below"), F.col("digest")).alias("digest"), F.sum("n_documents").alias("n_documents")).withColumn("level", F.lit(depth))
        every = level if every is None else every.unionByName(level)
        if not depth:
            return every
        depth -= 2
        level = level.select(F.substring("node", 1, depth).alias("node"), F.col("node").alias("below"), "digest", "n_documents")


def changed_turns(old: DataFrame, new: DataFrame, fan: int = FAN) -> DataFrame:
    """Places (document_id, sequence, change) at which two versions of turns differ: added, removed or changed.

    Documents first, by their trees' tops; then down the trees of those alone, block by block.
    """
    most = max(_furthest(old), _furthest(new))
    trees = [document_tree(turn_authorities(t), fan, most) for t in (old, new)]
    tops = [t.groupBy("document_id").agg(F.max_by("digest", "level").alias("digest")) for t in trees]
    differ = lambda a, b, keys: a.withColumnRenamed("digest", "was").join(b.withColumnRenamed("digest", "now"), keys, "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    names = written(differ(*tops, ["document_id"]).select("document_id"), "changed-documents")
    near = [written(document_tree(turn_authorities(t.join(names, "document_id", "left_semi")), fan, most), "changed-trees") for t in (old, new)]
    top, open_ = 1, None
    while fan**top <= most:
        top += 1
    for k in range(top, -1, -1):
        here = differ(*[t.filter(F.col("level") == k).drop("level") for t in near], ["document_id", "node"])
        if open_ is not None:
            here = here.withColumn("up", F.floor(F.col("node") / fan)).join(open_.select("document_id", F.col("node").alias("up")), ["document_id", "up"], "left_semi")
        open_ = here.select("document_id", "node", "was", "now")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return open_.select("document_id", F.col("node").alias("sequence"), change.alias("change"))
