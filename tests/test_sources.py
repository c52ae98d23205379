"""Files read and published; streams; layouts on given texts."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import records
from quarry.functions.text import mask_assignments, safe_category
from quarry.operators import meetings
from quarry.sources import files
from quarry.streaming import progress


def test_lines_keep_their_order_in_split_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(f'{{"schema":"event","id":{i}}}' for i in range(3000)))
    (tmp_path / "b.jsonl").write_text('{"schema":"event","id":1}\n\n[2]\n{"schema":"other"}\nnot json')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        lines = files.text_lines(spark, str(tmp_path))
        good, refused = files.parsed(lines, "schema string, id int", "event")
        rows = [(r["file"][-7:], r["line"], r["e"]["id"]) for r in good.collect()]
        assert sorted(r[1:] for r in rows if r[0] == "a.jsonl") == [(i + 1, i) for i in range(3000)]
        assert [r[1:] for r in rows if r[0] == "b.jsonl"] == [(1, 1)]
        assert sorted(r["line"] for r in refused.collect()) == [3, 4, 5]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    named = spark.createDataFrame([("x",), ("y",)], "folder string")
    assert sorted(map(tuple, files.unexpected_folders(named, spark.createDataFrame([("y",), ("z",)], "folder string")).collect())) == [("x", "missing"), ("z", "extra")]


def test_publishing(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    path = str(tmp_path / "p")
    assert files.publish(one, path) == files.publish(one.orderBy(F.desc("id")), path)
    assert sorted(map(tuple, files.published(spark, path).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError, match="other rows"):
        files.publish(one.limit(1), path)
    corpus = str(tmp_path / "c")
    a = files.replace_all({"items": one, "documents": one.limit(1)}, corpus)
    assert a == files.replace_all({"items": one, "documents": one.limit(1)}, corpus)
    assert a != files.replace_all({"items": one.limit(1), "documents": one}, corpus)
    assert files.current(spark, corpus, "items").count() == 1 and files.current(spark, corpus, "documents").count() == 2


def test_first_copies(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:30:00")], "k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert progress.first_copies(rows, "k", "at").count() == 2
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = progress.first_copies(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "at")
    query = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["k"] for r in spark.table("firsts").collect()) == ["a", "b"]


def test_layouts(spark):
    texts = spark.createDataFrame([(1, "0:05Speaker A hi\nmore\r\n0:07Speaker B yes"), (2, "Anna: one\nBen: two\n\nand"), (3, None), (4, " \n ")], "id int, text string")
    lines = meetings.with_forms(meetings.lines_of(texts, "id", "text"))
    got = sorted((r["id"], r["order"], r["speaker"], r["text"], r["source_line"]) for r in meetings.records(lines).collect())
    assert got == [(1, 1, "A", "hi more", 1), (1, 2, "B", "yes", 3), (2, 1, "Anna", "one", 1), (2, 2, "Ben", "two and", 2)]


def test_scalars(spark):
    row = spark.range(1).select(
        safe_category(F.lit("9-x")).alias("a"), safe_category(F.lit("X")).alias("b"), mask_assignments(F.lit("token = abc; password != x; secret: <REDACTED>")).alias("c"),
        records.canonical(b=F.lit(1), a=F.lit("é\"/"), z=F.lit(None).cast("string")).alias("d"), records.overlapping_ranges(F.lit("aaa"), F.lit("aa")).alias("e"),
    ).first()
    assert (row["a"], row["b"]) == ("9-x", "sensitive")
    assert row["c"] == "token = <REDACTED>; password != x; secret: <REDACTED>"
    assert row["d"] == '{"a":"é\\"/","b":1,"z":null}' and row["e"] == [0, 1]
