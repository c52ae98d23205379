"""Operators on cases that the tables do not hold."""

import random
import re

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import time as C
from quarry.operators import classify, relate, spans
from quarry.plans import evidence
from quarry.streaming import progress


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def span(*xs):
    return F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(c).alias("c")) for s, e, c in xs])


def test_apply_spans(spark):
    tag = lambda c: f'<redacted category="{c}"/>'
    assert one(spark, spans.applied(F.lit("A😀秘密Z"), span((2, 4, "p")))) == f"A😀{tag('p')}Z"
    assert one(spark, spans.applied(F.lit("abcdef"), span((3, 5, "q"), (1, 4, "p")))) == f"a{tag('p')}{tag('q')}f"
    assert one(spark, spans.applied(F.lit("abcdef"), span((1, 5, "p"), (2, 3, "q")))) == f"a{tag('p')}f"


def test_greedy_spans_follow_the_last_kept(spark):
    kept = one(spark, spans.without_overlaps(span((0, 5, "a"), (3, 8, "a"), (6, 9, "a"))))
    assert [(x["s"], x["e"]) for x in kept] == [(0, 5), (6, 9)]


def test_matches_offsets(spark):
    found = one(spark, spans.matches(F.lit("😀12 a 345"), "[0-9]+", "n"))
    assert [(x["s"], x["e"]) for x in found] == [(1, 3), (6, 9)]


def test_language_class(spark):
    for text, want in (("abcdefgh中中", "en"), ("中文中文中文中文ab", "zh"), ("abcde中文中文中", "mixed"), ("123 --", "mixed")):
        assert one(spark, T.language_class(F.lit(text))) == want


def test_text_functions(spark):
    assert one(spark, T.utf16_length(F.lit("A😀秘"))) == 4
    assert one(spark, T.slug(F.lit("--"))) == "item"
    assert one(spark, T.generic_marker(F.lit("  Ran   commands. "))) is True
    assert one(spark, T.option_normal(F.lit(" Yes.. "))) == "yes"
    assert one(spark, T.mask_assignments(F.lit("password = hunter2; token == x; secret: <REDACTED>"))) == "password = <REDACTED>; token == x; secret: <REDACTED>"
    for text, want in (("x sk-abcdefgh1", True), ("AKIA" + "A" * 16, True), ("password = abcd", True), ("risk-abcdefgh1", False)):
        assert one(spark, F.lit(text).rlike(T.CREDENTIAL)) is want


def test_instants(spark):
    read = lambda s: one(spark, C.instant(F.lit(s)))
    assert tuple(read("1970-01-01T02:00:00+02:00")) == (0, 0)
    assert tuple(read("1970-01-01T00:00:01.25Z")) == (1, 250_000_000)
    for bad in ("2024-02-30T00:00:00Z", "2024-01-01T00:00:00-00:00", "2024-01-01T00:00:00", "12:00", "2024-01-01T00:00:00+24:00"):
        assert read(bad) is None


def test_clocks(spark):
    for text, want in (("0:05", 300), ("12:30 AM", 1800), ("9:05:07 pm", 75_907), ("24:00", None), ("13:00 PM", None), ("1:60", None)):
        assert one(spark, C.clock_seconds(F.lit(text))) == want
    assert one(spark, C.minutes_seconds(F.lit(65.9))) == "1:05"
    assert one(spark, C.calendar_date(F.lit("2024-02-30"))) is None


def test_dispositions(spark):
    rows = [("1", "message", "human", "user", "Ran commands.", None, None), ("2", "message", "ai", "assistant", "Ran commands.", None, None), ("3", "message", "ai", "tool", "hello", None, None), ("4", "agent", "ai", None, " ", None, None), ("5", "artifact", "tool", None, "", "image", "1"), ("6", "artifact", "tool", None, "", "image", "2"), ("7", "message", None, None, "x", None, None)]
    df = spark.createDataFrame(rows, "item_id string, event_type string, actor_type string, role string, content string, kind string, created_by string")
    got = {r["item_id"]: r["disposition"] for r in classify.with_artifacts(classify.classified(df)).collect()}
    assert got == {"1": "keep_human_dialogue", "2": "drop_generic_execution_marker", "3": "drop_ambiguous", "4": "drop_agent_plumbing", "5": "keep_human_source", "6": "drop_machine_artifact", "7": "drop_ambiguous"}


def test_replays_and_conflicts(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 5, "c"), ("m", 4, "c")], "key string, pos int, fp string")
    got = {r["key"]: (r["pos"], r["fp"], r["copies"], r["conflict"]) for r in relate.collapse_replays(df, ["key"], "fp", ["pos"]).collect()}
    assert got == {"k": (1, "a", 2, True), "m": (4, "c", 2, False)}


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    counts = progress.windowed_counts(stream, late="60 days")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", marks).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, progress.windowed_counts(events).collect()))
    sink = spark.readStream.schema(events.schema).parquet(source).writeStream.foreachBatch(lambda b, i: progress.append_once(b, i, out)).option("checkpointLocation", marks + "2").start()
    sink.processAllAvailable()
    sink.stop()
    assert spark.read.parquet(out).count() == events.count()


def test_claims(spark):
    rows = [("Please add that it WORKS!", ["so, it works."]), ("add ab", ["ab"]), ("请补充说明 我们 成功 了", ["后来 我们 成功 了。"]), ("it works", []), (None, ["x"]), ("addition", None), ("😀 x", ["x"])]
    df = spark.createDataFrame(rows, "i string, c array<string>")
    got = df.select(T.claim_variants(F.col("i")), T.claim_supported(F.col("i"), F.col("c"))).collect()
    assert [r[0] for r in got] == [["please add that it works", "it works"], ["add ab"], ["请补充说明 我们 成功 了", "我们 成功 了"], ["it works"], [], ["addition"], []]
    assert [r[1] for r in got] == [True, False, True, False, False, False, False]


def test_leaks_against_places(spark):
    """Words cut by a span's ends, spans that overlap or reach out of the text, letters that grow when lowered; a text of very many words."""
    r = random.Random(4)
    texts = [(k, "".join(r.choice(["the ", "Ann", " ", "é", "-", "😀", "İ", "bo "]) for _ in range(30)), [(s := r.randrange(-2, 60), s + r.randrange(0, 25), "c") for _ in range(r.randrange(0, 5))]) for k in range(120)]
    texts += [(900, None, []), (901, "ann", None), (902, "İ the end", [(2, 5, "c")]), (903, "bo the " * 40_000, [(0, 100, "c"), (50, 60, "c")])]
    names, want = ["the", "ann", "bo", "é", "none"], {}
    for _, text, marks in texts:
        for w in re.finditer(r"[^\W_]+", text or ""):
            if (name := w[0].lower()) in names:
                sums = want.setdefault(name, [0, 0])
                sums[any(s <= w.start() and w.end() <= e for s, e, _ in marks or ())] += 1
    df = spark.createDataFrame(texts, "item_id long, content string, spans array<struct<s:int,e:int,c:string>>")
    got = {x["name"]: [x["leaks"], x["covered"]] for x in spans.leaks(df, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == want and want["the"][1] > 15


def test_most_overlap_of_equal_spans(spark):
    """Very many equal spans and turns are two; against all pairs for others."""
    r = random.Random(5)
    some = lambda n: [(k, s := r.randrange(-20, 90), s + r.randrange(0, 40)) for k in range(n)]
    a, b = some(150), some(60)
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} long, s long, e long")
    want = {}
    for i, s, e in a:
        met = [(min(e, te) - max(s, ts), -ts, label) for label, ts, te in b if e > s and te > ts and s < te and ts < e]
        if met:
            want[i] = (max(met)[2], max(met)[0])
    for width in (5, 16, 100):
        assert {x["id"]: (x["label"], x["overlap"]) for x in relate.most_overlap(df(a, "id"), df(b, "label"), width).collect()} == want
    many = lambda n, name: spark.range(n).select(F.col("id").alias(name), F.lit(3).cast("long").alias("s"), F.lit(9).cast("long").alias("e"))
    got = relate.most_overlap(many(300_000, "id"), many(200_000, "label"), 16).groupBy("label", "overlap").count().collect()
    assert [tuple(x) for x in got] == [(199_999, 6, 300_000)]


def test_units_that_name_none_are_not_joined(spark, data):
    found = evidence.i7_duplicate_units(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    # the left side's lines of the join
    asked = [line for line in found.split("Join LeftOuter", 1)[1].splitlines()[1:] if line.lstrip(" +-").startswith(":")]
    assert "isnotnull(of" in "\n".join(asked) or "% 7) = 0" in "\n".join(x for x in asked if "Filter" in x)
