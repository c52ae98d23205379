import random

from pyspark.sql import functions as F

from quarry.operators import fragments, proposals

ROSTER = "fragment_id long, fragment string, category string"


def naive(text, roster):
    """Leftmost first, of those the longest, found anew from each place."""
    out, at = "", 0
    while True:
        hits = [(i, -len(f), c) for _, f, c in roster if f and (i := text.find(f, at)) >= 0]
        if not hits:
            return out + text[at:]
        i, n, c = min(hits, key=lambda h: h[:2])
        out, at = f'{out}{text[at:i]}<redacted category="{c}"/>', i - n


def test_against_naive(spark, monkeypatch):
    r = random.Random(6)
    some = lambda n: "".join(r.choice("aé😀b") for _ in range(n))
    known = {some(r.randrange(1, 5)): f"kind-{k % 3}" for k in range(12)}
    roster = [(i, f, c) for i, (f, c) in enumerate(known.items())]
    texts = [(i, some(r.randrange(0, 40))) for i in range(200)] + [(900, None), (901, "b" * 100_000)]
    df, ros = spark.createDataFrame(texts, "i long, t string").coalesce(2), spark.createDataFrame([*roster, (99, None, "x"), (98, "", "x")], ROSTER)
    want = {i: None if t is None else naive(t, roster) for i, t in texts}
    places = {(i, k, s) for i, t in texts for k, f, _ in roster for s in range(len(t or "")) if (t or "").startswith(f, s)}
    for chunk in (fragments.CHUNK, 5):
        monkeypatch.setattr(fragments, "CHUNK", chunk)
        assert {x["i"]: x["o"] for x in fragments.redacted(df, ros, "t", "o").collect()} == want
        assert {(x["id"], x["fragment_id"], x["start"]) for x in fragments.occurrences(df, ros, "i", "t").collect()} == places
    none = spark.createDataFrame([], ROSTER)
    assert fragments.occurrences(df, none, "i", "t").collect() == [] and fragments.redacted(df, none, "t", "o").filter("i < 900 and t <> o").count() == 0


def test_odd_categories_are_plain(spark):
    ros = spark.createDataFrame([(1, "one", 'x"/><script>'), (2, "two", None), (3, "three", "ok-1")], ROSTER)
    got = fragments.redacted(spark.createDataFrame([("one two three",)], "t string"), ros, "t", "o").first()["o"]
    assert got == '<redacted category="sensitive"/> <redacted category="sensitive"/> <redacted category="ok-1"/>'


def test_nested_values(spark):
    """Strings in structs of arrays of maps, nulls at every depth, keys left alone, other types untouched."""
    kind = "struct<a:string,b:array<struct<c:map<string,array<string>>,d:int>>,e:struct<f:string,g:double>,h:array<int>>"
    rows = [
        (1, ("x secret", [({"secret": ["a secret b", None], "k": None}, 1), None, (None, 2)], ("secretsecret", 1.5), [1])),
        (2, None), (3, (None, None, None, None)), (4, ("plain", [], ("", None), [])),
    ]
    df = spark.createDataFrame(rows, f"i int, v {kind}").withColumn("__other", F.lit(1))
    tag = '<redacted category="person"/>'
    got = {x["i"]: x["v"] for x in fragments.redacted_value(df, spark.createDataFrame([(1, "secret", "person")], ROSTER), "v").collect()}
    assert got[1].asDict(True) == {"a": f"x {tag}", "b": [{"c": {"secret": [f"a {tag} b", None], "k": None}, "d": 1}, None, {"c": None, "d": 2}], "e": {"f": tag * 2, "g": 1.5}, "h": [1]}
    assert got[2] is None and got[3].asDict() == {"a": None, "b": None, "e": None, "h": None} and got[4].asDict(True) == {"a": "plain", "b": [], "e": {"f": "", "g": None}, "h": []}
    assert fragments.redacted_value(df, spark.createDataFrame([], ROSTER), "v").schema["v"].dataType == df.schema["v"].dataType
    plain = spark.createDataFrame([(1, [2])], "i int, v array<int>")
    assert fragments.redacted_value(plain, spark.createDataFrame([], ROSTER), "v").first()["v"] == [2]


MARKS = "array<struct<os:int,oe:int,ps:int,pe:int,category:string>>"


def test_each_fault_of_a_proposal(spark):
    text, new = "Anna met Ben.", "X met YY."
    good = [(0, 4, 0, 1, "person"), (9, 12, 6, 8, "person")]
    cases = {
        "ok": (new, good), "turned": (new, good[::-1]), "shape": (new, [(0, 0, 0, 1, "person")]), "null": (new, [(None, 4, 0, 1, "person")]), "name": (new, [(0, 4, 0, 1, "Person")]), "range": (new, [*good[:1], (9, 99, 6, 8, "person")]), "order": (new, [*good, (11, 12, 8, 9, "person")]), "gap": ("X saw YY.", good),
        "same": ("Anna met YY.", [(0, 4, 0, 4, "person"), (9, 12, 9, 11, "person")]), "tail": ("X met YY!", good), "secret": ("X met YY.", good), "unflagged": (new, good), "unchanged": (text, []), "kept": (text, []), "other": (new, good), "long": ("x" * 1_000_001, good),
    }
    codes = {"shape": "occurrence_shape", "null": "occurrence_shape", "name": "occurrence_shape", "range": "occurrence_range", "order": "occurrence_order", "gap": "gap", "same": "occurrence_unchanged", "tail": "tail", "secret": "credential", "unflagged": "not_flagged", "unchanged": "flagged_unchanged", "other": "content_digest", "long": "proposed_text", "absent": "proposal_missing"}
    secret = " password: hunter22"
    targets = spark.createDataFrame([(k, text + secret * (k == "secret")) for k in [*cases, "absent"]], "target_id string, content string").coalesce(1)
    rows = [(k, n + secret * (k == "secret"), m, k == "other") for k, (n, m) in cases.items()] + [("foreign", new, good, False), ("ok2", new, good, False), ("ok2", new, good, False)]
    given = spark.createDataFrame(rows, f"target_id string, proposed string, occurrences {MARKS}, other boolean").coalesce(1)
    targets = targets.union(spark.createDataFrame([("ok2", text)], targets.schema))
    given = given.join(targets, "target_id", "left").withColumn("content_digest", F.sha2(F.when(F.col("other"), "z").otherwise(F.coalesce("content", F.lit(""))), 256)).drop("content", "other")
    flagged = targets.filter("target_id not in ('unflagged', 'kept')").select("target_id")
    got = {x["target_id"]: x["code"] for x in proposals.proposal_codes(targets, given, flagged).collect()}
    assert got == {k: codes.get(k) for k in [*cases, "absent"]} | {"foreign": "target_unknown", "ok2": "target_repeated"}


def test_each_fault_of_a_match(spark):
    """An overlapping place wants a match of its own."""
    given = spark.createDataFrame([(1, "aXaXa b", "YY b", [(0, 5, 0, 2, "person")]), (2, "aXa tok", "aXa tok", [(0, 3, 0, 3, "person")])], f"target_id long, content string, proposed string, occurrences {MARKS}").coalesce(1)
    sources = spark.createDataFrame([(1, "aXa", "person"), (2, "tok", "api-token"), (3, "aXa", "person")], "source_id long, text string, category string").coalesce(1)
    match = lambda rows: spark.createDataFrame(rows, "target_id long, source_id long, start int, end int, relation string, reason string").coalesce(1)
    told = lambda rows: {tuple(x) for x in proposals.match_codes(given, sources, match(rows)).collect()}
    full = [(1, s, k, k + 3, "inherited", "same") for s in (1, 3) for k in (0, 2)] + [(2, 1, 0, 3, "unrelated", "a word"), (2, 3, 0, 3, "unrelated", "a word"), (2, 2, 4, 7, "inherited", "same")]
    assert told(full) == {(2, 2, 4, "not_covered")}
    assert told(full[1:]) == {(1, 1, 0, "match_missing"), (2, 2, 4, "not_covered")}
    bad = [*full[:4], (2, 1, 0, 3, "inherited", "x"), (2, 3, 0, 3, "odd", "x"), (2, 2, 4, 7, "unrelated", "x"), (1, 1, 1, 4, "inherited", "x"), (1, 3, 2, 5, "inherited", "again")]
    assert told(bad) == {(2, 1, 0, "still_there"), (2, 3, 0, "match_shape"), (2, 2, 4, "credential_unrelated"), (1, 1, 1, "match_unfounded"), (1, 3, 2, "match_repeated")}


def test_batches_are_bounded(spark):
    """Texts go to Python by bytes, not by numbers of rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(key)
    for use in (lambda df, ros: fragments.redacted(df, ros, "t", "o"), lambda df, ros: fragments.occurrences(df, ros, "i", "t"), lambda df, ros: fragments.redacted_value(df, ros, "t")):
        spark.conf.set(key, 256 << 20)
        use(spark.createDataFrame([(1, "ab")], "i long, t string"), spark.createDataFrame([(1, "a", "x")], ROSTER))
        assert int(spark.conf.get(key)) <= 4 << 20
    spark.conf.set(key, kept)


def test_texts_are_made_once(spark, monkeypatch):
    """However many chunks a roster has, what makes the texts is done once."""
    monkeypatch.setattr(fragments, "CHUNK", 3)
    made = spark.createDataFrame([(1, "abcde"), (2, "de")], "i long, t string").groupBy("i").agg(F.max("t").alias("t"))
    found = fragments.occurrences(made, spark.createDataFrame([(1, "ab", "x"), (2, "cd", "x"), (3, "de", "x"), (4, "bcde", "x")], ROSTER), "i", "t")
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(x["id"], x["fragment_id"], x["start"]) for x in found.collect()} == {(1, 1, 0), (1, 2, 2), (1, 3, 3), (1, 4, 1), (2, 3, 0)}


def test_proposals_in_bounded_tasks(spark, monkeypatch):
    from quarry.sources import work

    monkeypatch.setattr(work, "TASK_ROWS", 10)
    targets = spark.range(300).select(F.col("id").alias("target_id"), F.lit("a").alias("content"))
    given = targets.select("target_id", F.sha2("content", 256).alias("content_digest"), F.col("content").alias("proposed"), F.expr("cast(array() as array<struct<os:int,oe:int,ps:int,pe:int,category:string>>)").alias("occurrences"))
    found = proposals.proposal_codes(targets, given, targets.select("target_id").limit(0))
    assert found.filter("code is not null").count() == 0 and found.count() == 300
    assert "hashpartitioning(target_id" in (p := found._jdf.queryExecution().executedPlan().toString()) and ", 30)" in p
