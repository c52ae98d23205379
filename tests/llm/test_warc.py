import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import ranges, warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    least = {}
    for i, _, h in rows:
        least.setdefault(h or "", []).append(i)
    found = []
    for html, ids in least.items():
        data = html.encode()
        digest = hashlib.sha256(data).hexdigest()
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            again = len(data) >= 100 and k > 0
            found.append((i, len(data), digest, "revisit" if again else "response", ids[0] if again else None))
    return sorted(found, key=repr)


def made_up():
    r = random.Random(3)
    bodies = [f"<p>{'é' * n}\r\n\r\nWARC/1.1 {'x' * n}</p>" for n in (0, 10, 40, 300)] + ["", None, "z" * 99, "z" * 100]
    rows = [(i, r.choice(["http://a.example/x", "http://a.example/é?q=a: b", None, "bad\r\nX: y"]), r.choice(bodies)) for i in range(200)]
    # repeated rows and a null id
    return rows + rows[:30] + [(None, "u", "z" * 100), (None, "u", "q" * 200), (None, "u", "q" * 200), (7, "huge", "y" * 9_000_000)]


def test_all_pages(spark):
    rows = made_up()
    got = warc.page_archive(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_archives_are_standard(spark, tmp_path, monkeypatch):
    """Each file is a gzip file; offsets and lengths of the index cut it; ids that are referred to exist once."""
    root, index = warc.write_archives(spark.createDataFrame(made_up(), SCHEMA).repartition(3), str(tmp_path / "w"))
    rows = index.collect()
    for name in {r["archive"] for r in rows}:
        data = (tmp_path / "w" / name).read_bytes()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        mine = sorted((r["offset"], r["length"]) for r in rows if r["archive"] == name)
        assert mine[-1][0] + mine[-1][1] == len(data) and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:], strict=False))
    heads = [gzip.decompress((tmp_path / "w" / r["archive"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]).split(b"\r\n\r\n")[0].decode().split("\r\n") for r in rows]
    field = lambda h, k: next((x.split(": ", 1)[1] for x in h if x.startswith(k + ": ")), None)
    ids = [field(h, "WARC-Record-ID") for h in heads]
    assert len(ids) == len(set(ids))
    assert {field(h, "WARC-Refers-To") for h in heads} - {None} <= set(ids)


def test_selected_records_by_few_ranges(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h.example/{i}", f"<p>{i}</p>" * 40) for i in range(300)]
    root, index = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"))
    some = index.filter("page_id % 3 = 0")
    joined = warc.ranges(some).collect()
    assert len(joined) == 1 and len(joined[0]["records"]) == 100
    got = warc.read_records(root, some).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got} == {i: h for i, _, h in rows if i % 3 == 0}
    # no gap may be read
    monkeypatch.setattr(warc, "GAP", -1)
    assert warc.ranges(some).count() == 100
    monkeypatch.setattr(warc, "READ", 500)
    assert warc.ranges(index).count() > 20
    assert warc.read_records(root, index.filter("false")).collect() == []


def test_small_archives_and_damage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 2000)
    rows = [(i, "u", f"{i}" * 200) for i in range(40)]
    root, index = warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"))
    assert index.select("archive").distinct().count() > 2
    assert warc.read_records(root, index).count() == 40
    one = index.first()
    file = tmp_path / "w" / one["archive"]
    data = bytearray(file.read_bytes())
    data[one["offset"] + one["length"] // 2] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match=r"incorrect data check|digest|whole record|decompress|invalid"):
        warc.read_records(root, index).collect()


def test_empty_and_clashing_columns(spark):
    assert warc.page_archive(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "u", "a" * 100), (2, "u", "a" * 100)], SCHEMA)
    clash = df.withColumn("digest", F.lit(1)).withColumn("payload", F.lit("x")).withColumn("n_rows", F.lit(3)).withColumn("archive", F.lit(3))
    assert sorted(map(tuple, warc.page_archive(clash).collect()), key=repr) == brute([tuple(r) for r in df.collect()])


def test_joins_with_heavy_keys(spark, monkeypatch):
    """The join of rows with totals of their keys, heavy keys broadcast and the others shuffled, is a left join."""
    df = spark.createDataFrame([("a", i) for i in range(50)] + [(None, 1), ("b", 1), ("c", 1)], "k string, v int")
    totals = df.groupBy("k").agg(F.count("*").alias("n")).filter("k is null or k <> 'c'")
    want = sorted(map(repr, ranges.with_totals(df, totals, "k", "n").select("v", "n").collect()))
    monkeypatch.setattr(ranges, "BROADCAST_ROWS", 2)
    assert sorted(map(repr, ranges.with_totals(df, totals, "k", "n").select("v", "n").collect())) == want
