"""The trie of conversation prefixes, with the tokens that sharing saves.

Every conversation begins with turns of another one (``rebuilt``), so that prefixes are shared.
A node is a sequence of turns, named by two 64-bit sums of its turns and their places. The
smallest conversation that passes a node owns it, so a conversation owns a suffix of its
path: below the place where it parts from all smaller ones. Windows mark what is owned; then
one grouping by node sums over its members what each adds below it: bytes it meets but does not
own, children and leaves it owns. Nothing walks the trie level by level.

A conversation, a node or a list of ends may hold any share of the rows: windows run within
ranges (see ``ranges``), the ends of a node are joined to pieces of text where they lie, and only
the pieces of one node meet in one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import in_batches, partitions, text_of, written
from quarry.llm.ranges import across, laid_out

#: Conversations c to c + GROUP - 1, c a multiple of GROUP, begin with turns of c; the number of turns is crc32(c) % HEADS.
GROUP, HEADS = 5, 9
#: Characters of ids in one piece of a list of ends.
PIECE = 1 << 20


def _head(c: Column) -> Column:
    return F.crc32(F.encode(c.cast("string"), "UTF-8")) % HEADS


def _lanes(depth: Column, digest: Column) -> list[Column]:
    """Two 64-bit words of a turn at its place; a node is the exclusive or of those of its turns."""
    return [F.xxhash64(depth, digest).alias("x"), F.xxhash64(digest, depth, F.lit(1)).alias("y")]


def _before(totals: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per (part, group) of groups in several parts: what the parts before it add up to. At most two rows a part."""
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written(across(totals, group).select("part", *group, *[how.over(earlier).alias(c) for c, how in sums.items()]), "trie-before")


def placed(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns (c, p, digest, n_bytes, part), numbered from 1 in each conversation.

    Null turns come first; turns of one number are ordered by role and the digest of role
    and text. Null role and text are empty. Rows without conv_id belong to no conversation and
    are left out.
    """
    says, words = text_of(role), text_of(text)
    digest = F.unhex(F.sha2(F.encode(F.concat(F.length(says).cast("string"), F.lit(":"), says, words), "UTF-8"), 256))
    turns = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), says.alias("role"), digest.alias("digest"), F.octet_length(words).cast("long").alias("n_bytes")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    lying = laid_out(turns, ["c"], order, "trie-turns")
    totals = lying.groupBy("part", "c").agg(F.count("*").alias("n"))
    before = _before(totals, ["c"], {"n_before": F.sum("n")})
    own = Window.partitionBy("part", "c").orderBy(*order)
    numbered = lying.withColumn("q", F.row_number().over(own)).join(F.broadcast(before), ["part", "c"], "left")
    return numbered.select("c", (F.col("q") + F.coalesce("n_before", F.lit(0))).alias("p"), "digest", "n_bytes", "part")


def occurrences(turns: DataFrame) -> DataFrame:
    """Every conversation's path: (c, d, x, y, n_bytes, upto, n_turns, part), from the root at depth 0.

    ``turns`` as ``placed`` gives them, written. ``upto`` counts the bytes of the first d turns.
    """
    base = F.col("c") - F.col("c") % GROUP
    # of a base at most HEADS - 1 turns are wanted and at most 2 * GROUP - 1 conversations (around 0) begin with them
    heads = turns.filter(F.col("p") < HEADS).select("c", F.struct("p", "digest", "n_bytes").alias("t"))
    heads = heads.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("head")).withColumnRenamed("c", "b")
    lying = turns.groupBy("part", "c").agg(F.count("*").alias("n"))
    convs = lying.groupBy("c").agg(F.sum("n").alias("n_own"), F.min("part").alias("part"))
    convs = convs.withColumn("b", base).withColumn("h", _head(F.col("c"))).join(heads, "b", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<p:bigint,digest:binary,n_bytes:bigint>>")), F.lit(1), F.greatest(F.col("h"), F.lit(0)).cast("int")))
    k = F.size("head").cast("long")
    convs = convs.select("c", "part", "h", "head", k.alias("k"), (k + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"))
    convs = written(convs, "trie-conversations")

    # a conversation's facts, once for each part that holds some of its turns
    facts = lying.select("part", "c").join(convs.select("c", "h", "k", "n_turns"), "c")
    tail = turns.join(facts, ["part", "c"]).filter("p > h").withColumn("d", F.col("p") - F.col("h") + F.col("k"))
    tail = written(tail.select("c", "part", "d", *_lanes(F.col("d"), F.col("digest")), "n_bytes", "n_turns"), "trie-tails")
    top = convs.select("c", "part", "n_turns", F.explode("head").alias("t")).withColumn("d", F.col("t.p"))
    top = top.select("c", "part", "d", *_lanes(F.col("d"), F.col("t.digest")), F.col("t.n_bytes").alias("n_bytes"), "n_turns")
    root = convs.select("c", "part", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("n_bytes"), "n_turns")
    rows = written(root.unionByName(top).unionByName(tail), "trie-rows")

    sums = {"x": F.bit_xor, "y": F.bit_xor, "n_bytes": F.sum}
    totals = rows.groupBy("part", "c").agg(*[f(c).alias(c) for c, f in sums.items()])
    before = _before(totals, ["c"], {f"{c}_before": f(c) for c, f in sums.items()})
    run = Window.partitionBy("part", "c").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = lambda c: F.coalesce(f"{c}_before", F.lit(0))
    running = rows.select("c", "part", "d", "n_bytes", "n_turns", *[f(c).over(run).alias(f"run_{c}") for c, f in sums.items()]).join(F.broadcast(before), ["part", "c"], "left")
    return running.select(
        "c", "d", F.col("run_x").bitwiseXOR(carried("x")).alias("x"), F.col("run_y").bitwiseXOR(carried("y")).alias("y"), "n_bytes", (F.col("run_n_bytes") + carried("n_bytes")).alias("upto"), "n_turns", F.col("part").alias("lies")
    )


NODE = ["d", "x", "y"]


def marked(paths: DataFrame) -> DataFrame:
    """Each occurrence with the owner of its node, and whether the node has no children."""
    lying = laid_out(paths, NODE, [F.col("c")], "trie-nodes")
    ends = F.sum((F.col("d") == F.col("n_turns")).cast("long"))
    totals = lying.groupBy("part", *NODE).agg(F.min("c").alias("least"), F.count("*").alias("n"), ends.alias("ends"))
    every = Window.partitionBy(*NODE)
    over = across(totals, NODE).select("part", *NODE, F.min("least").over(every).alias("least"), (F.sum("n").over(every) == F.sum("ends").over(every)).alias("bare"))
    over = F.broadcast(written(over, "trie-wide-nodes"))
    here = Window.partitionBy("part", *NODE)
    local = lying.withColumn("c_least", F.min("c").over(here)).withColumn("c_bare", F.count("*").over(here) == ends.over(here))
    joined = local.join(over, ["part", *NODE], "left")
    return joined.select("c", *NODE, "n_bytes", "upto", "n_turns", "lies", F.coalesce("least", "c_least").alias("owner"), F.coalesce("bare", "c_bare").alias("bare"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of ends to pieces of joined ids: one row a node, more where a list is long."""
    node, first, ids, size = None, 0, [], 0

    def piece() -> dict:
        return {"d": node[0], "x": node[1], "y": node[2], "first": first, "ids": ",".join(ids)}

    for batch in batches:
        found = []
        for d, x, y, c in zip(*(batch[k].tolist() for k in ("d", "x", "y", "c")), strict=True):
            if (d, x, y) != node or size >= PIECE:
                if ids:
                    found.append(piece())
                node, first, ids, size = (d, x, y), c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if found:
            yield pd.DataFrame(found)
    if ids:
        yield pd.DataFrame([piece()])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pieces to one digest a node, read as a stream."""
    node, running = None, None
    for batch in batches:
        found = []
        for d, x, y, ids in zip(batch["d"].tolist(), batch["x"].tolist(), batch["y"].tolist(), batch["ids"], strict=True):
            if (d, x, y) == node:
                running.update(b",")
            else:
                if node:
                    found.append((*node, running.hexdigest()))
                node, running = (d, x, y), hashlib.sha256()
            running.update(ids.encode())
        if found:
            yield pd.DataFrame(found, columns=[*NODE, "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, running.hexdigest())], columns=[*NODE, "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """Digest of the conversations that end at each node at which some do."""
    n, node = partitions(paths.sparkSession), "d long, x long, y long"
    last = paths.filter("d = n_turns").select(*NODE, "c")
    ranged = last.repartitionByRange(n, *NODE, "c").sortWithinPartitions(*NODE, "c")
    pieces = in_batches(ranged).mapInPandas(_pieces, f"{node}, first long, ids string")
    whole = pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "first")
    return whole.mapInPandas(_digests, f"{node}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations.

    Returns conv_id (the smallest member), depth, parent_conv_id (the parent's, null at the
    root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256. Null role and text are
    empty; rows of null conv_id are left out; null turns come first, equal turns in the order of
    role and digest; repeated rows are turns of their own. A conversation left without turns is
    a member of the root. An empty table has no root. Texts of any length leave their row as
    digests; other columns are not read.
    """
    turns = written(placed(conversations, conv, turn, role, text), "trie-placed")
    paths = written(occurrences(turns), "trie-paths")
    seen = written(marked(paths), "trie-marked")
    foreign, mine = F.col("owner") < F.col("c"), F.col("owner") == F.col("c")
    facts = seen.groupBy("c").agg(
        F.coalesce(F.max(F.when(foreign, F.col("d"))) + 1, F.lit(0)).alias("d0"),
        F.max(F.when(foreign, F.struct("d", "owner"))).getField("owner").alias("above"),
        F.coalesce(F.max(F.when(foreign, F.struct("d", "upto"))).getField("upto"), F.lit(0)).alias("met"),
        F.max((mine & F.col("bare") & (F.col("d") == F.col("n_turns"))).cast("long")).alias("leaf"),
    )
    # once for each part that holds some of the path, so that no long path meets in one task
    facts = seen.select("lies", "c").distinct().join(facts, "c")
    rows = seen.join(facts, ["lies", "c"])
    start = F.col("upto") - F.col("n_bytes")
    parent = F.when(mine & (F.col("d") > 0), F.when(F.col("d") > F.col("d0"), F.col("c")).otherwise(F.col("above")))
    nodes = rows.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"),
        F.max(parent).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(((F.col("d") < F.col("n_turns")) & (F.col("d") + 1 >= F.col("d0"))).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(foreign, F.col("met") - start).otherwise(0)).alias("saved_tokens"),
    )
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends(paths), NODE, "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )
