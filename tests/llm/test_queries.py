"""Operators of the llm subpackage against SQL or brute force on the driver's rows and on made-up texts."""

import hashlib
import random
import re
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontam, exact_dedup, queries, secrets


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, data, name):
    db = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    want = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, data)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == sorted(map(repr, want.fetchall()))


def base(text):
    kinds = (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    )
    found = [(m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(kinds) for m in re.finditer(p, text or "", re.A) if len(m[g]) >= n]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def secrets_match(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.secret_report(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in want) for k in ("assign", "access", "hex")]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(got[i]["spans"].split(","))


def test_secrets_on_made_up_texts(spark):
    r = random.Random(2)
    pieces = ["password", "Token", "api_key", "APIKEY", '"', "'", " ", "=", ":", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "😀", ".", "\n", "-"]
    secrets_match(spark, ["".join(r.choice(pieces) for _ in range(r.randrange(1, 25))) for _ in range(800)] + ["", None])


def test_secrets_on_driver_rows(spark, data):
    secrets_match(spark, [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()])


def test_weak_parts_count_only_together(spark):
    token = "Zx9kQ2mW7pL4vB8nT3rY"
    df = spark.createDataFrame([(1, f"login: alice1 then {token} at https://db.example.org/x"), (2, f"only {token} here"), (3, "login: alice1"), (4, f"login: alice1 {'word ' * 100}{token}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_linked"] for r in secrets.secret_report(df).collect()} == {1: 3, 2: 0, 3: 0, 4: 0}


def test_scope_is_the_gap_between_parts(spark):
    token, url = "Zx9kQ2mW7pL4vB8nT3rY" * 13, "https://db.example.org/" + "x" * 220
    texts = [f"{token} user=bob", f"user=bob {token}", f"{url} {token}", f"{token} {'word ' * 39}user=bob", f"{token} {'word ' * 41}user=bob"]
    got = {r["doc_id"]: r["n_linked"] for r in secrets.secret_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 3: 2, 4: 0}


def test_links_against_all_pairs(spark):
    """Spans of a text with a scope, against the spans of one without bounds and the gaps of all their pairs."""
    r = random.Random(8)
    pieces = ["user=bob ", "Zx9kQ2mW7pL4vB8nT3rY ", "https://db.example.org/x ", "word " * 6, "Zx9kQ2mW7pL4vB8nT3rY" * 4 + " "]
    tail = "word " * 9 + "user=bob Zx9kQ2mW7pL4vB8nT3rY"  # completes every part where the scope has no bound
    df = spark.createDataFrame([(i, "".join(r.choice(pieces) for _ in range(r.randrange(2, 9))) + tail) for i in range(150)], "doc_id long, text string")
    role = {"ident": "id", "opaque": "secret", "endpoint": "endpoint"}
    cut = lambda rows: {x["doc_id"]: [(k, int(s), int(e)) for k, s, e in (y.split(":") for y in x["spans"].split(",") if y)] for x in rows.collect()}
    every, got = cut(secrets.secret_report(df, scope=10**6)), cut(secrets.secret_report(df, scope=30))
    linked = 0
    for i, spans in every.items():
        want = []
        for k, s, e in spans:
            near = {role[o] for o, s2, e2 in spans if max(s, s2) - min(e, e2) <= 30}
            if {"secret": bool(near & {"id", "endpoint"}), "id": "secret" in near, "endpoint": {"id", "secret"} <= near}[role[k]]:
                want.append((k, s, e))
        assert got[i] == want
        linked += len(want)
    assert linked


def test_links_name_their_parts(spark):
    token = "Zx9kQ2mW7pL4vB8nT3rY"
    texts = [f"login: alice1 then {token} at https://db.example.org/x", f"user=bob1 {token} user=bob2", f"{token} user=bob2", "password=hunter22 https://h.org/a", "password=hunter22", f"user=bob1 {'word ' * 50}{token}"]
    got = {r["doc_id"]: r["links"] for r in secrets.secret_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "opaque:19:39+ident:0:13+endpoint:43:67", 1: "opaque:10:30+ident:0:9", 2: "opaque:0:20+ident:21:30", 3: "assign:0:17+endpoint:18:33", 4: "", 5: ""}


def test_secrets_in_long_texts(spark):
    """A few hundred thousand characters of anything a pattern might try again and again."""
    pieces = ["a-", "aA1", "AKIA", "password ", "password=", "user=", "0123456789abcdef", "https://", "jdbc:", "token'", "\n", "é", "Zx9kQ2mW7pL4vB8nT3rY ", "password=hunter22 user=bob "]
    began = time.perf_counter()
    secrets_match(spark, [p * (200_000 // len(p)) for p in pieces])
    assert time.perf_counter() - began < 120


def test_secrets_edges(spark):
    df = spark.createDataFrame([(1, "token=abcdef", 1), (1, "token=abcdef", 1), (None, None, 2)], "doc_id long, text string, row long")
    assert sorted((str(r["doc_id"]), r["n_assign"]) for r in secrets.secret_report(df).collect()) == [("1", 1), ("1", 1), ("None", 0)]
    assert secrets.secret_report(df.filter("false")).count() == 0


def test_containment_against_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(r.choices(words, k=n)) for n in (1, 3, 5, 9, 20, 40, 60, 60)]
    docs = []
    for _ in range(120):
        w = r.choices(words, k=r.randrange(0, 80))
        item = r.choice(items).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            item[r.randrange(len(item))] = "other"
        docs.append(" ".join([*w, *item, *w[:5]]))
    docs += ["", None]

    def shingles(text, width):
        w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    want = set()
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            width = min(5, len(item.split()))
            s = shingles(item, width)
            if 10 * len(s & shingles(text, width)) >= 8 * len(s):
                want.add((d, i, len(s), len(s & shingles(text, width))))
    schema = "{} long, text string, n_shingles string, hash string, part string"
    a = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in enumerate(docs)], schema.format("doc_id"))
    b = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in enumerate(items)], schema.format("item_id"))
    got = decontam.contained_items(a, b)
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_matched"]) for r in got.collect()} == want
    clean = decontam.decontaminated(a, b)
    assert clean.columns == a.columns
    assert sorted(x["doc_id"] for x in clean.collect()) == sorted(set(range(len(docs))) - {w[0] for w in want})
    assert decontam.contained_items(a.filter("false"), b).count() == 0
    assert decontam.contained_items(a, b.filter("false")).count() == 0
    assert decontam.decontaminated(a, b.filter("false")).count() == len(docs)


def test_containment_of_repeated_rows_long_texts_and_clashing_columns(spark):
    """Rows and items that repeat, null ids, a text of half a million words, columns named like those within."""
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, item, "a", "b"), (1, item, "a", "b"), (None, item, "a", "b"), (2, "word " * 500_000 + item, "a", "b"), (3, "w1 w2", "a", "b"), (3, None, "a", "b")], "doc_id long, text string, __key string, row string")
    items = spark.createDataFrame([(7, item), (8, item), (8, item), (9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contained_items(docs, items).collect()}
    assert got == {(d, i) for d in (1, 2, None) for i in (7, 8)}
    clean = decontam.decontaminated(docs, items)
    assert clean.columns == docs.columns and sorted(map(repr, clean.collect())) == sorted(map(repr, docs.filter("doc_id = 3").collect()))


def test_digest_index_across_batches(spark):
    schema = "doc_id long, text string, batch string, keep_id string"
    one = spark.createDataFrame([(3, "a  b", "x", "x"), (1, "a b", "x", "x"), (2, None, "x", "x"), (4, "", "x", "x")], schema)
    two = spark.createDataFrame([(0, "a\tb", "x", "x"), (9, "new", "x", "x"), (9, "new", "x", "x"), (None, "new", "x", "x")], schema)
    from quarry.llm.common import work_path

    path = work_path(spark, "digest_test")
    index = exact_dedup.DigestIndex(spark, "digest_test", 4, path)
    take = lambda df, index=index: sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in index.dedup(df).collect()))
    first = [("1", 1, 2, True), ("2", 2, 2, True), ("3", 1, 2, False), ("4", 2, 2, False)]
    second = [("0", 1, 1, False), ("9", 9, 3, False), ("9", 9, 3, True), ("None", 9, 3, False)]
    assert take(one) == first
    assert take(two) == second
    # each again, in any order of rows: nothing is lost and the index does not grow
    assert take(one) == first and take(two.orderBy(F.desc("doc_id"))) == second and take(one) == first
    assert take(one.filter("false")) == []
    assert spark.table("digest_test").count() == spark.table("digest_test").select("text_sha256").distinct().count() == 3
    # a later session finds the table by its path
    spark.sql("DROP TABLE digest_test")
    again = exact_dedup.DigestIndex(spark, "digest_test", 4, path)
    assert take(two, again) == second
    again.drop()


def test_dedup_in_batches_is_that_of_one(spark):
    """Any number of batches by ranges of ids, against plain Python; a hot text and a hot id among them."""
    r = random.Random(3)
    rows = [(r.choice([None, 1, 1, *range(2, 60)]), r.choice(["a", "a", "a", " a", "b\tc", "b  c", "", None, *map(str, range(40))])) for _ in range(400)]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((d is None, d or 0))
    want = sorted((str(d), None if min(groups[norm(t)])[0] else min(groups[norm(t)])[1], len(groups[norm(t)])) for d, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tables = len(spark.catalog.listTables())
    for n in (1, 2, 5):
        got = exact_dedup.deduplicated(df, batches=n).collect()
        assert sorted((str(x["doc_id"]), x["keep_id"], x["group_size"]) for x in got) == want
        kept = [x for x in got if x["kept"]]
        assert len(kept) == len(groups) and all(x["doc_id"] == x["keep_id"] for x in kept)
    assert len(spark.catalog.listTables()) == tables
    assert exact_dedup.deduplicated(df.filter("false")).count() == 0
