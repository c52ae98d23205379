import os
import threading

import pytest
from pyspark.sql import functions as F

from quarry.sources import files, versions


def rows(spark, *values):
    return spark.createDataFrame([(v, "now") for v in values], "v int, saved_at string").coalesce(1)


def shown(df):
    return sorted(r["v"] for r in df.collect())


def test_a_save_names_the_version_it_was_made_from(spark, tmp_path):
    kept = versions.Versions(spark, str(tmp_path / "s"))
    assert kept.current() == (0, None)
    assert kept.save({"t": rows(spark, 1)}, 0, 7, "a") == {"ok": True, "saved": True, "version": 1, "code": None}
    assert kept.save({"t": rows(spark, 2)}, 0)["code"] == "version_conflict"
    assert kept.save({"t": rows(spark, 2)}, 2)["code"] == "version_conflict"
    assert kept.save({"t": rows(spark, 2)}, -1)["code"] == kept.save({"t": rows(spark, 2)}, 2**53 - 1)["code"] == "version_invalid"
    assert kept.save({"t": rows(spark, 2)}, 1, 7, current_source=8)["code"] == "source_conflict"
    # the same meaning is not saved again, another source revision is
    later = rows(spark, 1).withColumn("saved_at", F.lit("later"))
    assert kept.save({"t": later}, 1, 7)["saved"]
    assert kept.save({"t": rows(spark, 1)}, 2, 7, ignoring=("saved_at",))["saved"]
    assert not kept.save({"t": later}, 3, 7, ignoring=("saved_at",))["saved"]
    assert kept.save({"t": later}, 3, 8, ignoring=("saved_at",))["version"] == 4
    assert shown(kept.read("t", 1)) == [1] and kept.current()[1]["source_revision"] == 8


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    """Both have seen the same version before either commits."""
    path, gate, said = str(tmp_path / "s"), threading.Barrier(2, timeout=120), {}
    versions.Versions(spark, path).save({"t": rows(spark, 0)}, 0)
    claim = versions.Versions._claim
    monkeypatch.setattr(versions.Versions, "_claim", lambda self, *a: (gate.wait(), claim(self, *a))[1])

    def write(v):
        said[v] = versions.Versions(spark, path).save({"t": rows(spark, v)}, 1)

    both = [threading.Thread(target=write, args=(v,)) for v in (1, 2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    winner = [v for v, x in said.items() if x["saved"]]
    assert len(winner) == 1 and {x["code"] for v, x in said.items() if v not in winner} == {"version_conflict"}
    assert shown(versions.Versions(spark, path).read("t")) == winner


def test_a_dead_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    files.replace_all({"t": rows(spark, 1)}, path)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions.Versions, "_claim", dies)
        with pytest.raises(KeyboardInterrupt):
            files.replace_all({"t": rows(spark, 2)}, path)
    assert shown(files.current(spark, path, "t")) == [1]
    with monkeypatch.context() as m:
        m.setattr(os, "link", dies)
        with pytest.raises(KeyboardInterrupt):
            files.replace_all({"t": rows(spark, 2)}, path)
    assert shown(files.current(spark, path, "t")) == [1] and not os.listdir(f"{path}/drafts")
    files.replace_all({"t": rows(spark, 3)}, path)
    assert shown(files.current(spark, path, "t")) == [3]


def test_by_way_of_the_store(spark, tmp_path, monkeypatch):
    """The path of stores other than local folders: renamed, and refused if the version is there."""
    kept = versions.Versions(spark, str(tmp_path / "s"))
    monkeypatch.setattr(versions, "urlparse", lambda _: type("U", (), {"scheme": "hdfs"}))
    assert kept.save({"t": rows(spark, 1)}, 0)["saved"] and not kept._claim(1, "{}")
    assert shown(kept.read("t")) == [1] and kept._claim(2, "{}") and kept.current() == (2, {})


def test_recorded_once(spark, tmp_path):
    path = str(tmp_path / "r")
    assert versions.record_once(rows(spark, 1, 2), path) == versions.record_once(rows(spark, 2, 1), path, attempt=2) == 1
    with pytest.raises(ValueError, match="other rows"):
        versions.record_once(rows(spark, 3), path)
    with pytest.raises(ValueError, match="corrections"):
        versions.record_once(rows(spark, 1), path, attempt=3)
