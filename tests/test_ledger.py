import random

from pyspark.sql import functions as F

from quarry.functions import diff
from quarry.operators import groups, ledger, shards

BLOCK = "chapter long, block string, language string, text string"
ACTION = "chapter long, seq long, kind string, block string, language string, start int, end int, inserted string, target string, supported boolean"


def working(spark, blocks, rows):
    """Each block's text with its active edits, from the ledger alone."""
    kept = {}
    for (c, b, la), text in blocks.items():
        mine = [r for r in rows if (r["chapter"], r["block"]) == (c, b)]
        for revision in range(2, max((r["revision"] for r in rows if r["chapter"] == c), default=1) + 1):
            text = ledger.projected(text, [r for r in mine if r["applied_revision"] == revision])[0]
        kept[c, b] = ledger.projected(text, [r for r in mine if r["resolution"] in ledger.ACTIVE])[0]
    return kept


def test_actions_against_plain_texts(spark):
    """Only edits, applied at times: the ledger's text is the text edited in place; the ledger has no fault."""
    r = random.Random(9)
    blocks = {(c, b, "en"): f"Some text {c} of block {b} to edit." for c in range(40) for b in "ab"}
    plain, actions = {(c, b): t for (c, b, _), t in blocks.items()}, []
    for c in range(40):
        for seq in range(14):
            b = r.choice("ab")
            start = r.randrange(0, 30)
            actions.append((c, seq, "apply" if seq % 5 == 4 else "edit", b, "en", start, start + r.randrange(0, 4), r.choice(["", "x", "new ", "😀"]), None, True))
    texts = spark.createDataFrame([(*k, t) for k, t in blocks.items()], BLOCK)
    acts = spark.createDataFrame(actions, ACTION)
    said = {(x["chapter"], x["seq"]): x["result"] for x in ledger.outcomes(texts, acts).collect()}
    assert {"recorded", "unchanged", "overlap", "applied"} <= set(said.values())
    for c, seq, kind, b, _, s, e, new, _, _ in actions:
        if said[c, seq] == "recorded":
            plain[c, b] = plain[c, b][:s] + new + plain[c, b][e:]
    rows = ledger.transactions(texts, acts)
    assert working(spark, blocks, [x.asDict() for x in rows.collect()]) == plain
    history = rows.filter("resolution = 'applied'").groupBy("chapter", F.col("applied_revision").alias("revision")).agg(F.collect_list("id").alias("ids"))
    assert ledger.faults(rows, texts, history).filter("code <> 'history_gap'").collect() == []
    last = ledger.replayed(texts, rows.filter("resolution = 'applied'").withColumn("kind", F.lit("edit")))
    shots = ledger.snapshots(texts, rows.filter("resolution = 'applied'").withColumn("kind", F.lit("edit")))
    final = {(x["chapter"], x["block"]): x["text"] for x in shots.orderBy("revision").collect()}
    assert {(x["chapter"], x["block"]): x["text"] for x in last.collect()} == final and not shots.filter("void").count()


def one(spark, actions, text="The quick brown fox."):
    rows = [(1, i, a.get("kind", "edit"), a.get("block", "a"), "en", a.get("start"), a.get("end"), a.get("inserted"), a.get("target"), a.get("supported", False)) for i, a in enumerate(actions)]
    texts, acts = spark.createDataFrame([(1, "a", "en", text)], BLOCK), spark.createDataFrame(rows, ACTION)
    return [x["result"] for x in ledger.outcomes(texts, acts).orderBy("seq").collect()], sorted(ledger.transactions(texts, acts).collect(), key=lambda x: x["created_at"])


def test_each_rule(spark):
    edit = lambda s, e, t, **k: {"start": s, "end": e, "inserted": t} | k
    # an edit inside an earlier one changes it; taking it back makes it reverted
    said, rows = one(spark, [edit(4, 9, "slow"), edit(4, 8, "quick")])
    assert said == ["recorded", "recorded"] and [x["resolution"] for x in rows] == ["reverted"]
    # across two edits: refused; touching an insert: part of it
    said, rows = one(spark, [edit(0, 3, "A"), edit(13, 16, "cat"), edit(0, 15, "x"), edit(1, 1, "n old")])
    assert said == ["recorded", "recorded", "overlap", "recorded"] and [x["after_text"] for x in rows] == ["An old", "cat"]
    # undo takes the last changed one, redo brings it back, a new edit forgets what could be redone
    undo, redo = {"kind": "undo"}, {"kind": "redo"}
    assert one(spark, [undo, edit(0, 3, "A"), edit(14, 17, "cat"), undo, redo, undo, edit(4, 4, "very "), redo])[0] == ["nothing", "recorded", "recorded", "undone", "redone", "undone", "recorded", "nothing"]
    # discarding leaves nothing to redo
    assert one(spark, [edit(0, 3, "A"), {"kind": "discard", "target": "a:edit:0"}, redo, {"kind": "discard", "target": "none"}])[0] == ["recorded", "discarded", "nothing", "nothing"]
    # a claim without support stops the revision; applied edits can be taken back while they are the last
    apply, back = {"kind": "apply"}, {"kind": "revert", "target": "a:edit:0"}
    said, rows = one(spark, [edit(0, 3, "7"), apply])
    assert said == ["recorded", "needs_evidence"] and rows[0]["resolution"] == "needs_evidence"
    said, rows = one(spark, [edit(0, 3, "A"), apply, back, apply, back, {"kind": "confirm"}, edit(0, 1, "x")])
    assert said == ["recorded", "applied", "reverting", "applied", "overlap", "confirmed", "confirmed"] and rows[1]["reverts"] == "a:edit:0" and rows[0]["revision"] == 3
    # refused inputs
    assert one(spark, [edit(0, 99, "x"), edit(2, 1, "x"), edit(0, 0, "a\0"), edit(0, 0, "x" * 20_001), edit(0, 3, "The"), edit(0, 1, "x", block="none"), {"kind": "odd"}])[0] == ["invalid"] * 4 + ["unchanged", "invalid", "invalid"]


def test_void_and_notes(spark):
    texts = spark.createDataFrame([(1, "a", "en", "one two three"), (1, "b", "en", "four"), (2, "a", "en", "five six"), (3, "a", "en", None)], BLOCK)
    change = "chapter long, id string, block string, language string, kind string, start int, end int, before_text string, after_text string, base_revision int, applied_revision int"
    notes = [(1, "n1", "a", "en", "delete", 4, 7, "two", None, 1, 2), (1, "n2", "a", "en", "add", 8, 13, "three", "four", 1, 2), (1, "n3", "b", "en", "revise", 0, 4, "four", "4", 2, 3)]
    shots = lambda rows: {(x["chapter"], x["block"], x["revision"]): x["text"] for x in ledger.snapshots(texts, spark.createDataFrame(rows, change)).collect()}
    first = {(1, "a", 1): "one two three", (1, "b", 1): "four", (2, "a", 1): "five six", (3, "a", 1): ""}
    assert shots(notes) == first | {(1, "a", 2): "one three four", (1, "b", 2): "four", (1, "a", 3): "one three four", (1, "b", 3): "4"}
    # one note that does not meet its text voids the chapter, not its neighbours
    two = (2, "e", "a", "en", "edit", 0, 4, "five", "5", 1, 2)
    for bad in [(1, "n4", "b", "en", "edit", 0, 1, "x", "y", 1, 2), (1, "n4", "a", "en", "edit", 0, 1, "o", "y", 1, 2), (1, "n4", "none", "en", "edit", 0, 0, "", "y", 1, 2), (1, "n4", "b", "en", "edit", 0, 1, "f", "y", 1, 3), (1, "n4", "a", "en", "revise", 5, 8, "wo ", "y", 1, 2)]:
        assert shots([*notes, bad, two]) == first | {(2, "a", 2): "5 six"}
    same = {(x["chapter"], x["block"]): x["text"] for x in ledger.replayed(texts, spark.createDataFrame([*notes, (1, "n4", "b", "en", "edit", 0, 1, "x", "y", 1, 2)], change)).collect()}
    assert same == {(1, "a"): "one three four", (1, "b"): "four", (2, "a"): "five six", (3, "a"): ""}


def test_evidence_rule_is_one(spark):
    r = random.Random(2)
    bits = ["a", "9", ". ", ".", "\n", " ", "https://x", "/a/b/c", "C:\\", "。", "word " * 8, ""]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(3))), "".join(r.choice(bits) for _ in range(r.randrange(4))), r.choice([0, 3]), r.choice([5, 9])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, b string, a string, s int, e int")
    op = F.when(F.col("b") == "", "insert").when(F.col("a") == "", "delete").otherwise("replace")
    got = {x["i"]: x["n"] for x in df.select("i", ledger.needs_evidence(op, F.col("b"), F.col("a"), F.col("s"), F.col("e"), F.lit(9)).alias("n")).collect()}
    assert got == {i: ledger._needs_evidence(ledger.operation(b, a), b, a, s, e, 9) for i, b, a, s, e in rows}


def naive(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    t = 0
    while t < min(len(a), len(b)) - k and a[-1 - t] == b[-1 - t]:
        t += 1
    return None if a == b else (k, len(a) - t, b[k : len(b) - t])


def test_splice(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("aé😀") for _ in range(r.randrange(9))), "".join(r.choice("aé😀") for _ in range(r.randrange(9)))) for _ in range(500)]
    big = "word é😀 " * 150_000
    rows += [(big, big[:500_000] + "X" + big[500_003:]), (big, big), ("", "x"), (None, "x")]
    got = [x[0] for x in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(diff.splice(F.col("a"), F.col("b"))).collect()]
    assert [None if g is None else tuple(g) for g in got] == [None if a is None else naive(a, b) for a, b in rows]


def test_splice_by_caret(spark):
    rows = [("aaa", "aaaa", 1, (0, 0, "a")), ("aaa", "aaaa", 4, (3, 3, "a")), ("aaa", "aaaa", 9, (3, 3, "a")), ("aaa", "aa", 1, (1, 2, "")), ("abc", "xyz", 0, (0, 3, "xyz"))]
    got = [tuple(x[0]) for x in spark.createDataFrame([x[:3] for x in rows], "a string, b string, c int").coalesce(1).select(diff.splice(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [x[3] for x in rows]


def test_shards_against_naive():
    r = random.Random(3)
    for _ in range(100):
        n = r.randrange(1, 40)
        rows = [(str(r.randrange(50)).encode() + str(i).encode(), r.randrange(1, 30), r.randrange(1, 9)) for i in range(n)]
        k = r.randrange(1, 8)
        totals, want = [(0, 0, 0, j) for j in range(k)], [0] * n
        for i in sorted(range(n), key=lambda i: (-rows[i][1], -rows[i][2], rows[i][0])):
            b, c, m, j = min(totals)
            totals[j], want[i] = (b + rows[i][1], c + rows[i][2], m + 1, j), j
        assert shards.balanced(rows, k) == want
        room, held, put = [], [], [0] * n
        for i in sorted(range(n), key=lambda i: (-rows[i][1], rows[i][0])):
            j = next((j for j in range(len(room)) if room[j] >= rows[i][1] and held[j] < 4), len(room))
            if j == len(room):
                room.append(25)
                held.append(0)
            room[j], held[j], put[i] = room[j] - rows[i][1], held[j] + 1, j
        assert shards.first_fit(rows, 25, 4) == put
        found = shards.fewest(rows, 60, 10)
        sizes = lambda s, k: max(9 + sum(x[1] + 1 for x, y in zip(rows, s, strict=True) if y == j) for j in range(k))
        least = max(1, -(-sum(x[1] for x in rows) // 60))
        fits = [j for j in range(least, n + 1) if sizes(shards.balanced(rows, j), j) <= 60]
        assert found == (shards.balanced(rows, fits[0]) if fits else None)


def test_shards_that_fail(spark, monkeypatch):
    rows = spark.createDataFrame([("p", "a", 10, 1), ("p", "b", 900, 1), ("q", "c", 95, 1), ("r", "d", 5, None), ("r", None, 5, 1), (None, "e", 1, 1)], "project string, id string, bytes int, content_bytes int")
    got = {(x["group"], x["id"], x["shard"], x["error"]) for x in shards.semantic_shards(rows, "project", 100, 10).collect()}
    assert got == {("p", "b", None, "record_too_large"), ("q", None, None, "envelope_too_large"), ("r", "d", 0, None), ("r", "", 0, None)}
    monkeypatch.setattr(shards, "MOST", 1)
    got = {(x["group"], x["error"]) for x in shards.bins(rows, "project").collect()}
    assert got == {("p", "too_many_records"), ("q", None), ("r", "too_many_records")}

def odd_records(spark):
    """Groups of few and many records: equal sizes and ids, nulls, nothing, and more than a bin or shard holds."""
    r = random.Random(8)
    rows = [(g, r.choice([None, "é", "😀", "Z", f"{i}"]) if i % 9 == 0 else f"{g}{i:03}", r.choice([None, 0, 1, 5, 7, 20, r.randrange(40), 130 if g == "big" else 3]), r.choice([None, 0, 3, r.randrange(9)])) for g, n in (("a", 1), ("b", 3), ("c", 4), ("big", 90), ("many", 300), (None, 9)) for i in range(n)]
    return spark.createDataFrame(rows, "project string, id string, bytes int, content_bytes int")


def placed(df):
    found = [tuple(x) for x in df.select("group", "id", "shard", "place", "error").collect()]
    return sorted(found, key=str), {x[4] for x in found}


def test_large_groups_in_bins(spark, monkeypatch):
    """Groups too large to hold are placed whole, as if they were held."""
    rows = odd_records(spark).cache()
    for most, records in ((100, 4), (60, 50), (100, 1)):
        want = placed(shards.bins(rows, "project", most, records))
        assert want[1] == {None} and len(want[0]) == 398
        with monkeypatch.context() as m:
            m.setattr(shards, "HELD", 3)
            assert placed(shards.bins(rows, "project", most, records)) == want


def test_a_million_records_in_bins(spark):
    rows = spark.range(1_000_001).select(F.lit("g").alias("project"), F.col("id").cast("string").alias("id"), (F.col("id") % 5 + 1).alias("bytes"), F.lit(0).alias("content_bytes"))
    found = shards.bins(rows, "project", 10, 4)
    of = found.join(rows, "id").groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("place").alias("place"))
    got = of.agg(F.sum("n"), F.max("bytes"), F.max("n"), F.sum((F.col("place") + 1 != F.col("n")).cast("int")), F.count("*"), F.max("shard")).first()
    # pairs of 5, of 4, threes of 3; then 2 and 1 fill up
    sizes = [(b, 0, 200_001 if b == 1 else 200_000) for b in (5, 4, 3, 2, 1)]
    bins = max(int(x[3].max()) for x in shards.first_fit_counted(sizes, 10, 4)) + 1
    assert tuple(got) == (1_000_001, 10, 4, 0, bins, bins - 1)

def test_large_groups_in_parts(spark, monkeypatch):
    rows = odd_records(spark).cache()
    for identities, target in ((4, 50), (1_000, 70), (1_000, 10**9), (1, 1)):
        want = placed(shards.balanced_groups(rows, "project", identities, target))
        assert want[1] == {None} and len(want[0]) == 398
        with monkeypatch.context() as m:
            m.setattr(shards, "HELD", 3)
            assert placed(shards.balanced_groups(rows, "project", identities, target)) == want


def test_large_groups_in_shards(spark, monkeypatch):
    rows = odd_records(spark).cache()
    for most, envelope, errors in ((150, 10, {None}), (150, 149, {"envelope_too_large"}), (100, 10, {None, "record_too_large"})):
        want = placed(shards.semantic_shards(rows, "project", most, envelope))
        assert want[1] == errors
        with monkeypatch.context() as m:
            m.setattr(shards, "HELD", 3)
            assert placed(shards.semantic_shards(rows, "project", most, envelope)) == want


def test_a_million_records_in_parts(spark):
    rows = spark.range(1_000_001).select(F.lit("g").alias("project"), F.col("id").cast("string").alias("id"), (F.col("id") % 5 + 1).alias("bytes"), F.lit(0).alias("content_bytes"))
    of = shards.balanced_groups(rows, "project", 10, 10**9).join(rows, "id").groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("place").alias("place"))
    got = of.agg(F.sum("n"), F.count("*"), F.max("shard"), F.min("bytes"), F.max("bytes"), F.sum((F.col("place") + 1 != F.col("n")).cast("int"))).first()
    # parts of 10 or 11 records, filled up by single bytes
    assert tuple(got[:3]) == (1_000_001, 100_001, 100_000) and got[4] - got[3] <= 1 and got[5] == 0






def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_over_batches(spark):
    """A group that runs over any number of batches is folded once, whole; small ones share a call."""
    r = random.Random(3)
    rows = sorted((f"g{r.randrange(9)}", k) for k in range(60))
    want = {g: [x for x in rows if x[0] == g] for g, _ in rows}
    for size in (1, 2, 7, 100):
        batches = [groups.pa.RecordBatch.from_pylist([dict(zip("gk", x, strict=True)) for x in rows[i : i + size]]) for i in range(0, 60, size)]
        assert [x for out in groups.walked(batches, lambda k, held: [(k, held)]) for x in out] == sorted(want.items())
    assert list(groups.walked([], lambda k, held: [(k, held)])) == []
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    df = spark.createDataFrame([(g, k if k % 4 else None) for g, k in rows] + [(None, 5)], "g string, k long")
    got = {x["g"]: (x["n"], x["low"]) for x in groups.folded(df, "g", lambda key, held: [(key, len(held), held[0][1])], "g string, n long, low long", order=("k",)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == {g: (len(v), None if any(k % 4 == 0 for _, k in v) else min(k for _, k in v)) for g, v in want.items()}


def test_chapters_share_a_call(spark):
    texts, acts = spark.createDataFrame([], BLOCK), spark.createDataFrame([], ACTION)
    changes = spark.createDataFrame([], "chapter long, id string, block string, language string, kind string, start int, end int, before_text string, after_text string, base_revision int, applied_revision int")
    for df in (ledger.transactions(texts, acts), ledger.outcomes(texts, acts), ledger.snapshots(texts, changes), ledger.replayed(texts, changes)):
        assert "MapInArrow" in plan(df) and "CoGroup" not in plan(df)


def test_groups_of_records_share_a_call(spark):
    rows = spark.createDataFrame([], "project long, id string, bytes long, content_bytes long")
    for df in (shards.semantic_shards(rows, "project", 100, 10), shards.balanced_groups(rows, "project", 5, 100), shards.bins(rows, "project")):
        assert "MapInArrow" in plan(df) and "FlatMapGroups" not in plan(df)
