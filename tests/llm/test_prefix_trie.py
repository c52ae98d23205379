import hashlib
import random
import zlib

from pyspark.sql import functions as F

from quarry.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    key = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", key(r))):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    found = []
    for node, of in members.items():
        below = [(n, m) for n, m in members.items() if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(of) if rebuilt[c] == node)
        leaves = sum(all(len(rebuilt[c]) == len(n) for c in m) for n, m in below)
        saved = sum((len(m) - 1) * len(n[-1][1].encode()) for n, m in below if n)
        found.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), sum(len(n) == len(node) + 1 for n, _ in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def held(spark, rows):
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_made_up(spark):
    """Few texts, many shared turns, ties, nulls, repeated rows, negative ids, absent bases."""
    r = random.Random(4)
    ids = [i for i in range(-6, 40) if i % 7] + [2**40]
    rows = [(c, r.choice([None, 0, 1, 2, 3]), r.choice(["user", "assistant", None]), r.choice(["a", "é", "", None, "b" * 50])) for c in ids for _ in range(r.randrange(1, 12))]
    held(spark, rows + rows[:20] + [(None, 1, "user", "lost")])


def test_hot_conversation_and_copies(spark):
    """One conversation longer than a range, many equal ones, one very long text."""
    rows = [(1000, t, "user", f"t{t % 3}") for t in range(300)] + [(c, t, "user", f"t{t}") for c in range(60) for t in range(4)] + [(2000, 0, "user", "x" * 1_000_000)]
    held(spark, rows)


def test_pieces_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    held(spark, [(c, 0, "user", "same") for c in range(0, 400, 5)])


def test_empty_and_clashing_columns(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "a"), (6, 0, "user", "a")], SCHEMA)
    more = df.withColumn("part", F.lit("x")).withColumn("c", F.lit(7)).withColumn("__row", F.lit(0)).withColumn("d", F.lit(1))
    assert sorted(prefix_trie.prefix_trie(more).collect()) == sorted(prefix_trie.prefix_trie(df).collect())
