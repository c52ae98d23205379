"""N-gram Jaccard join over a token-group matrix.

Equal shingle sets are one node. Nodes that may be similar share a token of their prefixes
(the first n - ceil(t n) + 1 tokens in one global order). The order is rare first, by a sketch
of token counts over the whole corpus, so that shared passages bring nobody together; it
decides the cost and never the result. A token that few nodes (``PAIRED`` at most) share is a
bucket small enough to give its pairs, which parities of the token sets then thin out: most
small groups of copies are found so. For the others, which near copies in great numbers share:

* every node joins the group of one leader met under its prefix tokens, and is compared with
  that leader alone: this settles most near copies by one comparison each;
* a node not tied to its leader, or tied into another component, is a query against the
  groups it shares a prefix token with. A group is stored in blocks, each with its token union;
  the overlap with the union bounds the overlap with any member, and only blocks whose bound
  reaches ceil(t n) are opened. In an open block all members are counted through token postings.

No step lists the pairs within a large group: what leaves a block is at most one link per query
and component. Every pair that links is compared, or already joined by other links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_batches, small, text_of, written
from quarry.llm.components import components
from quarry.llm.shingles import set_digests, shingle_sets

#: Counters of the token count sketch, by leading bits; fixed, so what is broadcast is 2 MB.
SKETCH_BITS = 21
SKETCH_CHUNK = 1 << 16
#: Partial counts that are added up at once.
FAN = 64
#: A token that at most so many nodes share gives their pairs; a group is formed around others.
PAIRED = 32
#: Stands for a null doc_id on the way through pandas, where a null would turn ids into floats.
NO_ID = -(2**63)
#: Tokens in a block of a group, and queries sent to a block in one piece.
BLOCK_TOKENS, BLOCK_QUERIES = 60_000, 4_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _packed(part: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, after one byte that says how many."""
    size = next(k for k in (1, 2, 4, 8) if int(part.max()) < 256**k)
    return bytes([size]) + part.astype(f"<u{size}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _nodes_and_sketch(width: int):
    """Rows (doc_id, key, n, node), and the task's token counts as rows (chunk, part, counts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for at, hashes, ends in shingle_sets(batch["text"], width):
                met, often = np.unique(hashes >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                counts[met] += often.astype(np.int32)
                ids, keys = (batch[c].iloc[at : at + len(ends)].to_numpy() for c in ("doc_id", "key"))
                yield pd.DataFrame({"doc_id": ids, "key": keys, "n": np.diff(ends, prepend=0), "node": _signed(set_digests(hashes, ends)), "chunk": None, "part": None, "counts": None})
        task = TaskContext.get().partitionId()
        for chunk, part in enumerate(counts.reshape(-1, SKETCH_CHUNK)):
            if part.any():
                yield pd.DataFrame({"doc_id": [None], "key": None, "n": None, "node": None, "chunk": chunk, "part": task, "counts": [_packed(part)]})

    return run


def _summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SKETCH_CHUNK, np.int64)
    for raw in rows["counts"]:
        total += _unpacked(raw)
    return pd.DataFrame({"chunk": [key[0]], "part": [key[1]], "counts": [_packed(total)], "total": [int(total.sum())]})


def _levels(sketch: DataFrame) -> np.ndarray:
    """How frequent the tokens of each counter are, 0 to 255. The driver gets one byte per counter, whatever the corpus."""
    # a tree over the tasks: no group holds more than FAN of their counts, however many tasks there are
    tasks, sums = (sketch.agg(F.max("part")).first()[0] or 0) + 1, sketch
    while tasks > 1 or sums is sketch:
        sums = sums.groupBy("chunk", F.floor(F.col("part") / FAN).cast("int").alias("part")).applyInPandas(_summed, "chunk int, part int, counts binary, total long")
        tasks = -(-tasks // FAN)
    sums = written(sums, "token-sketch")
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / (1 << SKETCH_BITS)

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bytes_of = [np.minimum(_unpacked(x) * (64 / max(mean, 16)), 255).astype(np.uint8).tobytes() for x in batch["counts"]]
            yield pd.DataFrame({"chunk": batch["chunk"], "level": bytes_of})

    found = np.zeros((1 << SKETCH_BITS) // SKETCH_CHUNK * SKETCH_CHUNK, np.uint8).reshape(-1, SKETCH_CHUNK)
    for row in sums.mapInPandas(level, "chunk int, level binary").toLocalIterator():
        found[row["chunk"]] = np.frombuffer(row["level"], np.uint8)
    return found.ravel()


def _prefixes(width: int, t: int, levels: np.ndarray):
    """Rows (node, doc_id, n, keys, bits): keys are the prefix tokens, bits the parities. Sets of equal text repeat."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, hashes, ends in shingle_sets(batch["text"], width):
                sizes = np.diff(ends, prepend=0)
                owner = np.repeat(np.arange(len(ends)), sizes)
                order = np.lexsort((hashes, levels[hashes >> np.uint64(64 - SKETCH_BITS)], owner))
                rank = np.arange(len(hashes)) - np.repeat(ends - sizes, sizes)
                keep = rank < (sizes - -(-t * sizes // 100) + 1)[owner]
                keys = np.split(_signed(hashes[order][keep]), np.cumsum(np.bincount(owner[keep], minlength=len(ends)))[:-1])
                frame = {"node": _signed(set_digests(hashes, ends)), "doc_id": batch["doc_id"].iloc[at : at + len(ends)].to_numpy(), "n": sizes, "keys": keys, "bits": [_parities(x) for x in np.split(hashes, ends[:-1])]}
                yield pd.DataFrame(frame)[sizes > 0]

    return run


def _parities(tokens: np.ndarray) -> bytes:
    """One bit per counter of tokens, odd or even; about as many counters as tokens."""
    bits = max(64, 1 << int(len(tokens) - 1).bit_length()) if len(tokens) else 64
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _may_link(t: int):
    """Pairs that the parities don't rule out: two sets differ in at least as many tokens as parities."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for m, n, a, b in zip(batch["m"], batch["n"], batch["a"], batch["b"], strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                while len(a) != len(b):  # the longer folds to half the counters
                    if len(a) < len(b):
                        a, b = b, a
                    a = a[: len(a) // 2] ^ a[len(a) // 2 :]
                keep.append(int(np.bitwise_count(a ^ b).sum()) <= m + n - 2 * -(-t * (m + n) // (100 + t)))
            yield batch.loc[keep, ["node", "home"]]

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, hashes, ends in shingle_sets(batch["text"], width):
                yield pd.DataFrame({"node": _signed(set_digests(hashes, ends)), "n": np.diff(ends, prepend=0), "tokens": np.split(_signed(hashes), ends[:-1])})

    return run


def _links_in_block(t: int):
    """Members (tokens, component) and queries of one block: at most one link per query and component."""

    def run(key: tuple, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(members) and len(queries):
            sizes = members["tokens"].str.len().to_numpy()
            tokens = np.concatenate(members["tokens"].to_list())
            owner = np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(tokens, kind="stable")
            owner = owner[order]
            union, first = np.unique(tokens[order], return_index=True)
            last = np.append(first[1:], len(tokens))
            node, component = members["node"].to_numpy(), members["component"].to_numpy()
            for q, own, asked in zip(queries["q_node"], queries["q_component"], queries["q_tokens"], strict=True):
                asked = np.asarray(asked)
                at = np.searchsorted(union, asked)
                at[at == len(union)] = 0
                at = at[union[at] == asked]
                if len(at) < -(-t * len(asked) // 100):
                    continue
                posted = np.concatenate([owner[first[a] : last[a]] for a in at])
                shared = np.bincount(posted, minlength=len(members))
                near = np.flatnonzero((100 * shared >= t * (sizes + len(asked) - shared)) & (component != own) & (node != q))
                _, one = np.unique(component[near], return_index=True)
                out += [(q, node[k]) for k in near[one]]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), text_of(text_col))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; rows link at a Jaccard of ``percent`` or more.

    component_id is the smallest doc_id that links reach. Null and empty texts have no
    shingles and link with nothing: they are their own component, as is a row of null
    doc_id, whose component_id is then that of other rows with its shingles, or null.
    Repeated rows repeat in the result. Rows of one doc_id and different texts are kept
    apart. An empty table gives no rows. Other columns are not read. With ``keys`` also
    key (of id and text), node (the set's digest) and component (null without shingles).
    """
    given = F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of(text_col).alias("text"))
    keyed = rows.withColumn("key", _key("doc_id", "text") if keys else F.lit(0).cast("long"))
    seen = in_batches(keyed).mapInPandas(_nodes_and_sketch(width), "doc_id long, key long, n long, node long, chunk int, part int, counts binary")
    seen = written(seen.select(given, "key", "n", "node", "chunk", "part", "counts"), "shingled")
    levels = _levels(seen.filter("chunk is not null").select("chunk", "part", "counts"))

    prefixed = in_batches(rows).mapInPandas(_prefixes(width, percent, levels), "node long, doc_id long, n long, keys array<long>, bits binary").select("node", given, "n", "keys", "bits")
    nodes = prefixed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    nodes = written(nodes, "nodes")
    posted = nodes.select("node", "n", "copies", F.explode("keys").alias("key"))
    buckets = posted.groupBy("key").agg(F.count("*").alias("met"), F.max(F.struct("copies", "node")).alias("leader")).filter("met > 1")
    # written, here and below, so that a hot key meets a table of one row a key, and its rows can be split
    buckets = written(buckets, "buckets")
    met = posted.join(buckets, "key").select("node", "n", "key", F.struct("leader.copies", "met", "leader.node").alias("leader"))
    met = written(met, "met")

    few = met.filter(F.col("leader.met") <= PAIRED).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "node"))).alias("all"))
    # ascending by size: a partner is at least as large, and not too large
    later = F.filter(F.slice("all", F.col("i") + 2, F.size("all")), lambda x: x["n"] * percent <= F.col("one.n") * 100)
    few = few.select("all", F.posexplode("all").alias("i", "one")).select(F.col("one.node").alias("node"), F.explode(later["node"]).alias("home"))
    met = met.filter(F.col("leader.met") > PAIRED)
    homes = written(met.groupBy("node", "n").agg(F.max("leader").alias("leader")).select("node", "n", F.col("leader.node").alias("home")), "homes")
    pairs = few.select(F.least("node", "home").alias("node"), F.greatest("node", "home").alias("home")).distinct()
    pairs = pairs.union(homes.select("node", "home").filter("node <> home"))
    pairs = pairs.join(nodes.select("node", F.col("n").alias("m"), F.col("bits").alias("a")), "node").join(nodes.select(F.col("node").alias("home"), "n", F.col("bits").alias("b")), "home")
    pairs = written(pairs.mapInPandas(_may_link(percent), "node long, home long"), "pairs")

    wanted = pairs.select("node").union(pairs.select(F.col("home").alias("node"))).union(homes.select("node")).distinct()
    wanted = written(nodes.select("node", "doc_id").join(wanted, "node", "left_semi"), "wanted")
    held = rows.join(small(wanted.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = in_batches(held).mapInPandas(_sets(width), "node long, n long, tokens array<long>").filter("n > 0")
    # repeated rows repeat their set; that only repeats comparisons
    sets = written(sets.join(small(wanted.select("node")), "node", "left_semi").select("node", "tokens"), "sets")

    lead = sets.select(F.col("node").alias("home"), F.col("tokens").alias("lead"))
    shared = F.size(F.array_intersect("tokens", "lead"))
    linked = 100 * shared >= percent * (F.size("tokens") + F.size("lead") - shared)
    # not made distinct within the join: that would keep a leader's many copies in one task
    ties = written(pairs.join(sets, "node").join(lead, "home").filter(linked).select("node", "home"), "ties-repeated")
    ties = written(ties.distinct(), "ties")
    first = components(ties.select(F.col("node").alias("u"), F.col("home").alias("v")), "first-components")
    state = homes.join(ties.select("node", "home", F.lit(True).alias("tied")), ["node", "home"], "left").join(first, "node", "left")
    tied = F.coalesce("tied", F.col("node") == F.col("home"))
    state = written(state.select("node", "n", "home", tied.alias("tied"), F.coalesce("component", "node").alias("component")), "state")

    # queries against groups, where a link could still join two components
    placed = met.select("node", "key").join(state, "node")
    at_key = placed.groupBy("key", "home").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.min("n").alias("n_least"), F.max("n").alias("n_most"),
    )
    at_key = written(at_key, "at-key")
    mixed = written(at_key.groupBy("key").agg(F.min("least").alias("a"), F.max("most").alias("b")).filter("a <> b").select("key"), "mixed-keys")
    # narrow tables of their own: sent to the nodes where small, else joined so that a hot key can be split
    at_key = written(at_key.join(small(mixed), "key", "left_semi"), "at-mixed-key")
    asked = placed.join(small(mixed), "key", "left_semi").withColumnRenamed("home", "own")
    near = (F.col("n_most") * 100 >= F.col("n") * percent) & (F.col("n_least") * percent <= F.col("n") * 100)
    other = (F.col("least") != F.col("component")) | (F.col("most") != F.col("component"))
    # of two tied nodes one asks: the one of the larger component number
    turn = ~F.col("tied") | (F.col("least") < F.col("component"))
    queries = asked.join(small(at_key), "key").filter(near & other & turn).select("node", "component", "home").distinct()
    queries = written(queries, "queries")

    members = state.join(queries.select("home").distinct(), "home", "left_semi")
    sizes = members.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    pieces = queries.groupBy("home").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("pieces"))
    shape = written(sizes.join(pieces, "home"), "shape")
    stored = members.join(small(shape), "home").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    stored = stored.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    stored = stored.select("node", "component", "home", F.col("block").cast("int"), "piece").join(sets, "node")
    sent = queries.join(small(shape), "home").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("node", "component", "home", "block", "piece").join(sets, "node")
    sent = sent.select(*[F.col(c).alias(f"q_{c}") for c in sent.columns])
    at = ["home", "block", "piece"]
    links = stored.groupBy(*at).cogroup(sent.groupBy(*[f"q_{c}" for c in at])).applyInPandas(_links_in_block(percent), "u long, v long")
    links = written(links, "links")

    edges = ties.select(F.col("node").alias("u"), F.col("home").alias("v")).unionByName(links)
    found = components(edges, "components")
    joined = nodes.select("node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = written(joined.join(least, "component").select("node", "component_id", "component"), "named")
    result = seen.filter("chunk is null").join(named, "node", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *(["key", "node", "component"] if keys else []))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each group: the smallest doc_id; of its repeated rows one. All columns.

    Texts of one doc_id are decided each by its own group. Of several in one group the one of
    the smallest set digest stays. Rows of null doc_id stay, and of documents without
    shingles all that differ in id or text.
    """
    groups = similar_groups(docs, id_col, text_col, keys=True, **options).filter("doc_id is not null and doc_id = component_id")
    rows = groups.groupBy("doc_id", "key", "component", "node").agg(F.count("*").alias("n"))
    one = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct("node", "key", "doc_id", "n")).alias("one")).select("one.doc_id", "one.key", "one.n")
    kept = one.unionByName(rows.filter("component is null").select("doc_id", "key", "n"))
    kept = written(kept.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "n"), "kept")
    mine = (F.col(id_col).cast("long") == F.col("__id")) & (_key(id_col, text_col) == F.col("__key"))
    # whole rows are shuffled for repeated ids and texts only
    once, often = kept.filter("n = 1").drop("n"), kept.filter("n > 1").drop("n")
    out = docs.join(small(once), mine, "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
    if often.isEmpty():
        return out
    # rows as one value, so that no column of theirs can clash
    repeated = docs.join(small(often), mine, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return out.unionByName(repeated.dropDuplicates(["id", "text"]).select("row.*"))
