import hashlib
import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import vector_codes
from quarry.llm.vector_codes import grown, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(Fraction(float(np.float32(x))) * 1024) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = len(kept[0][1]) // 4
    cut = lambda v: [v[k * size : (k + 1) * size] for k in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    least = lambda p, book: min(range(len(book)), key=lambda e: (far(p, book[e]), e))
    one = {}
    for i, v, _ in kept:
        one[i] = min(v, one.get(i, v))
    seeds = sorted(one, key=lambda i: (i is None, i or 0))[:entries]
    books = [[cut(one[i])[k] for i in seeds] for k in range(4)]
    for _ in range(rounds):
        new = []
        for k, book in enumerate(books):
            of = [[] for _ in book]
            for _, v, _ in kept:
                of[least(cut(v)[k], book)].append(cut(v)[k])
            new.append([[sum(c) // len(ps) for c in zip(*ps, strict=True)] if ps else e for e, ps in zip(book, of, strict=True)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, [least(p, b) for p, b in zip(cut(v), books, strict=True)], v, label) for i, v, label in kept]
    error = lambda at, v: sum(far(p, b[e]) for p, b, e in zip(cut(v), books, at, strict=True))
    labels = {}
    for _, at, v, label in coded:
        labels[label] = labels.get(label, 0) + error(at, v)
    fits = lambda x: x if abs(x) < 2**63 else None
    return sorted([(i, "".join(f"{e:02x}" for e in at), fits(error(at, v)), fits(labels[label]), digest) for i, at, v, label in coded], key=repr)


def held(spark, rows, **how):
    got = vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(5), **how)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, **how)


def test_tree_against_all_entries():
    """Ties at equal bounds: few distinct values, so that many entries are equally near."""
    r = np.random.default_rng(1)
    for spread in (2, 3, 50):
        for n in (1, 5, 40, 256):
            entries, parts = r.integers(-spread, spread, (n, 5)), r.integers(-spread - 2, spread + 2, (500, 5))
            far = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
            at, best = nearest(grown(entries, np.arange(n)), parts)
            assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_against_brute_force(spark):
    """Ties, repeated rows and ids, null ids and labels, unusable vectors."""
    r = random.Random(5)
    rows = [(r.choice([*range(60), None]), [r.choice([-0.5, 0.25, 0.1, -0.001, 3.0]) for _ in range(8)], r.choice([0, 1, None])) for _ in range(150)]
    odd = [(1, None, 0), (2, [None] * 8, 0), (3, [math.nan] * 8, 1), (4, [math.inf] * 8, 1), (0, [-math.inf] + [0.0] * 7, 1)]
    held(spark, rows + rows[:10] + odd, entries=20)
    held(spark, rows[:7])


def test_very_large_components(spark):
    held(spark, [(i, [1e30 * i, -3e38, 1e-40, 5.0], 1) for i in range(5)] + [(9, [0.0, 0.0, 0.0, 0.0], 2)], entries=3)


def test_edges(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    # of other length: left out; no components at all: one code
    rows = [(1, [1.0] * 4, 1), (2, [2.0] * 4, 1), (3, [1.0] * 5, 1)]
    assert {x["vec_id"] for x in vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 2}
    assert [(x["code"], x["error"]) for x in vector_codes.vector_codes(spark.createDataFrame([(1, [], 1)], SCHEMA)).collect()] == [("00000000", 0)]
    df = spark.createDataFrame(rows[:2], SCHEMA)
    clash = df.withColumn("vector", F.lit(1)).withColumn("code", F.lit("x")).withColumn("error", F.lit(3)).withColumn("n", F.lit(3))
    assert sorted(vector_codes.vector_codes(clash).collect()) == sorted(vector_codes.vector_codes(df).collect())
