import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import layouts

TEXTS = {
    "stamped": "0:05Speaker A hello there\ngoing on\n\n0:09Speaker B  yes\n12:30Speaker A bye", "labels": "Anna: hello\nBen Li: yes\nAnna： full width", "metadata": "Date: 2024-01-02\nAgenda: things\nplain words\nmore", "lower": "anna: lower\nben: case\ncarl: names",
    "links": "Anna: http://x.org/a\nCarl: /path\nwords", "control": "Anna: a\x07\nBen: b\x07\nmore\nwords", "steps": "Step one: do\nChapter two: read\nwords", "empty": "", "blank": " \n\n", "role": "speaker: aaa\nSpeaker 1: bbb\nSpeaker 2: ccc", "half_clocks": "Speaker 1: b\nSpeaker 2: c",
    "brackets": "[Anna] 9:05 AM\none\ntwo\n\n[Ben] 9:06 AM\nthree", "repeats": "Anna Bo 09:05\none\nAnna Bo 09:06\ntwo", "lone": "Anna Bo 09:05\none", "odd_one": "Anna 09:05\none\nAnna 09:06\ntwo\nBen 09:07\nx", "two_lone": "Anna 09:05\none\nBen 09:06\ntwo", "back": "[Anna] 09:05\none\n[Ben] 09:04\ntwo",
    "no_body": "[Anna] 09:05\n[Ben] 09:06\ntwo", "early": "words\n[Ben] 09:06\ntwo", "half": "[Anna] 09:05\none\nBen 9:6\ntwo", "broken": "[Anna 09:05\none", "mixed": "[Anna] 09:05\nBen: said\nmore", "midnight": "[Anna] 12:05 AM\none\n[Ben] 12:10 am\ntwo\n[Ben] 1:00 PM\nx", "role_time": "Speaker 1 09:05\none", "paren": "Anna (Host) 09:05\none\nwords",
    "noon_back": "[Anna] 12:05 PM\none\n[Ben] 11:10 AM\ntwo", "lower_time": "we met at 09:05\nand left at 09:06", "bad_clock": "[Anna] 25:05\none",
}
FORMATS = {
    "stamped": "timestamped", "labels": "speaker-labeled", "metadata": "plain", "lower": "plain", "links": "plain", "control": "plain", "steps": "plain", "empty": "empty", "blank": "empty", "role": "speaker-labeled", "half_clocks": "invalid",
    "brackets": "speaker-time", "repeats": "speaker-time", "lone": "plain", "odd_one": "invalid", "two_lone": "invalid", "back": "invalid", "no_body": "invalid", "early": "invalid", "half": "invalid", "broken": "invalid", "mixed": "invalid", "midnight": "speaker-time", "role_time": "speaker-time", "paren": "speaker-time",
    "noon_back": "invalid", "lower_time": "plain", "bad_clock": "invalid",
}


def test_formats(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "name string, text string").coalesce(1)
    assert {x["id"]: x["format"] for x in layouts.formats(df, "name", "text").collect()} == FORMATS


def test_records(spark):
    df = spark.createDataFrame([(k, TEXTS[k]) for k in ("stamped", "labels", "brackets", "midnight", "lone", "back")], "name string, text string").coalesce(1)
    found = sorted((x["id"], x["order"], x["clock"], x["speaker"], x["text"], x["source_line"]) for x in layouts.records(df, "name", "text").collect() if x["format"] != "plain")
    assert found == [
        ("brackets", 1, "9:05 AM", "Anna", "one\ntwo", 1), ("brackets", 2, "9:06 AM", "Ben", "three", 5), ("labels", 1, None, "Anna", "hello", 1), ("labels", 2, None, "Ben Li", "yes", 2), ("labels", 3, None, "Anna", "full width", 3),
        ("midnight", 1, "12:05 AM", "Anna", "one", 1), ("midnight", 2, "12:10 am", "Ben", "two", 3), ("midnight", 3, "1:00 PM", "Ben", "x", 5), ("stamped", 1, "0:05", "A", "hello there going on", 1), ("stamped", 2, "0:09", "B", "yes", 4), ("stamped", 3, "12:30", "A", "bye", 5),
    ]
    assert [x["text"] for x in layouts.records(df.filter("name = 'lone'"), "name", "text").orderBy("order").collect()] == ["Anna Bo 09:05", "one"]


def test_structures(spark):
    cases = {
        "one line": "plain", "words\nmore words": "plain", "9:05,Anna,hello\n9:06,Ben,yes": "unsupported", "9:05;Anna;hello\n9:06;Ben;yes": "unsupported", "Anna - 9:05 - hello\nBen - 9:06 - yes": "unsupported", "9:05,Anna,hello\nx,y": "invalid",
        "<Anna>\none\n<Ben>\ntwo": "unsupported", "<Anna>\n<Ben>\ntwo": "invalid", "words\n<Anna>\none\n<Ben>\ntwo": "invalid", "<Anna>\none\n<Ben>": "invalid", "<Anna>\none\n{x}\n{y}\n<Ben>\ntwo": "invalid", "<a> x\n<b> y": "unsupported", "#a\n#b": "plain", "yes, no!\nno, yes!": "plain",
        "<Anna>\none": "plain", "": "plain", "###\n###": "plain",
    }
    df = spark.createDataFrame([(t, t) for t in cases], "name string, text string").coalesce(1)
    assert {x["id"]: x["structure"] for x in layouts.structures(df, "name", "text").collect()} == cases


def test_plans(spark):
    header = {"record_form": "header_body", "blank_lines": "body", "prefix": "<<< ", "separator": " | ", "suffix": " >>>", "fields": ["speaker", "timestamp"]}
    row = {"record_form": "row", "blank_lines": "record_separator", "prefix": "", "separator": "\t", "suffix": "", "fields": ["timestamp", "speaker", "body"]}
    good, rows = "<<< Anna | 9:05 >>>\none\n\ntwo\n<<< Ben | 9:06 >>>\r\nthree\r\n", "9:05\tAnna\thello\n\n9:06\tBen\tyes"
    parting = header | {"blank_lines": "record_separator"}
    bad = "SOURCE_LAYOUT_MISMATCH"
    cases = [
        (good, header, None), (rows, row, None), (good, header | {"prefix": "<<<<"}, bad), (good, parting, bad), (good.replace("\n\ntwo", "\n\n"), parting, None), ("x\n" + good, header, bad), (good.replace("9:06", "9:04"), header, bad), (good.replace("9:06", "nine"), header, bad),
        (good.split("<<< Ben")[0], header, bad), (good.replace("three\r\n", ""), header, bad), (good.replace("Ben", " Ben"), header, bad), (good.replace("three", "th\x07ree"), header, bad), (rows + "\n", row, None), (rows + "\n\n", row, bad), ("\n" + rows, row, bad), (rows.replace("\n\n", "\n\n\n"), row, bad), (rows + "\nnone", row, bad),
        (good, header | {"fields": ["speaker", "body"]}, "PLAN_CONTRACT_INVALID"), (good, header | {"separator": ""}, "PLAN_CONTRACT_INVALID"), (rows, row | {"blank_lines": "body"}, "PLAN_CONTRACT_INVALID"), (good, header | {"prefix": "\t"}, "PLAN_CONTRACT_INVALID"), (good, header | {"suffix": "x" * 65}, "PLAN_CONTRACT_INVALID"), (good, header | {"record_form": None}, "PLAN_CONTRACT_INVALID"),
        (good, header | {"fields": ["speaker"], "prefix": "", "separator": "", "suffix": ""}, "PLAN_CONTRACT_INVALID"), (good.replace("<<< Anna | 9:05 >>>", "<<< Anna |  >>>"), header, None),
    ]
    texts = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "name int, text string").coalesce(1)
    plans = spark.createDataFrame([(i, *[p[c] for c in layouts.PLAN[1:]]) for i, (_, p, _) in enumerate(cases)], "id int, record_form string, blank_lines string, prefix string, separator string, suffix string, fields array<string>").coalesce(1)
    plans = plans.join(texts.select(F.col("name").alias("id"), F.sha2("text", 256).alias("source_digest")), "id")
    outcomes, records = layouts.planned(texts, plans, "name", "text")
    assert {x["id"]: x["code"] for x in outcomes.collect()} == {i: code for i, (_, _, code) in enumerate(cases)}
    found = {(x["id"], x["order"]): (x["clock"], x["speaker"], x["text"], x["source_line"]) for x in records.collect()}
    assert found[0, 1] == ("9:05", "Anna", "one\n\ntwo", 1) and found[0, 2] == ("9:06", "Ben", "three", 5) and found[1, 2] == ("9:06", "Ben", "yes", 3) and found[24, 1][0] is None


def test_digest_of_another_text(spark):
    texts = spark.createDataFrame([(1, "a")], "name int, text string")
    plans = spark.createDataFrame([(1, "0" * 64, "row", "record_separator", "", ",", "", ["speaker", "body"])], "id int, source_digest string, record_form string, blank_lines string, prefix string, separator string, suffix string, fields array<string>")
    assert layouts.planned(texts, plans, "name", "text")[0].first()["code"] == "SOURCE_DIGEST_MISMATCH"


@pytest.mark.parametrize("text", ["a\nb\r\nc\rd", "x\x0by\x85z w", "", "\n\n", "no end"])
def test_lines_join_to_their_text(spark, text):
    found = layouts.physical(spark.createDataFrame([(1, text)], "i int, t string"), "i", "t").orderBy("line").collect()
    assert [x["raw"] for x in found] == text.splitlines(keepends=True) and re.sub("[\r\n]+$", "", text) == "".join(x["raw"] for x in found).rstrip("\r\n")
