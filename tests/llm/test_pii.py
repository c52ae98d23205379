import hashlib
import random
import re
import time

from quarry.llm import pii

SCHEMA = "doc_id long, text string, spans string"


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(re.fullmatch(r"0*([0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])", x) for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in out)


def check(spark, texts):
    rows = list(enumerate(texts))
    got = {int(r["doc_id"]): r for r in pii.personal_data(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()}
    for i, t in rows:
        base = brute(t)
        assert got[i]["spans"].startswith(base)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x.startswith(k + ":") for x in base.split(",")) for k in pii.BASE]


def test_random_strings(spark):
    r = random.Random(5)
    pieces = ["@", "+", ".", "-", " ", "a", "B", "1", "23", "4111 1111 1111 1111", "192.168.0.1", "x@y.zz", "(", ")", "256", "é", "😀", "İ", "+49 30 1234567", "\n"]
    check(spark, ["".join(r.choice(pieces) for _ in range(r.randrange(1, 40))) for _ in range(1500)] + ["", None])


def test_driver_rows(spark, data):
    check(spark, [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()])


def test_added_kinds_and_redaction(spark):
    df = spark.createDataFrame([(1, "Account no: 12345678, see HTTPS://ex.org/a?u=1. Bye", "x"), (2, None, "y"), (3, "mail a@b.org now", "z")], SCHEMA)
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()}
    assert got["1"] == "account:12:20,url:26:46"
    texts = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert texts == {1: "Account no: [account], see [url]. Bye", 2: None, 3: "mail [email] now"}
    assert pii.personal_data(df.filter("false")).count() == 0


def test_long_texts_take_linear_time(spark):
    """Digits, signs and cues by the hundred thousand; an address part of any length."""
    check(spark, ["0" * 5000 + ".1.1.1", "1.1.1." + "0" * 5000 + "7", "9" * 5000 + ".1.1.1"])
    pieces = ["1", "1.", "1 ", "+1(", "+", "@", "a@b", "a.b@", "x@y.z", "account ", "http://", "http://.", "é@", "1-", "4111 1111 1111 1111 "]
    began = time.perf_counter()
    for p in pieces:
        pii.find(p * (300_000 // len(p)), pii._automaton())
    assert time.perf_counter() - began < 60


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(7, "a@b.org", "x"), (7, "a@b.org", "x"), (None, "a@b.org", "y")], SCHEMA)
    assert sorted((str(r["doc_id"]), r["spans"]) for r in pii.personal_data(df).collect()) == [("7", "email:0:7"), ("7", "email:0:7"), ("None", "email:0:7")]
