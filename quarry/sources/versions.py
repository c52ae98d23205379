"""Versions of a set of tables: a save names the version it was made from and fails if that has moved.

Data are written first, under a name of their own; a version is one small file, linked or renamed to
its number, which a store does as one step and refuses if the number is taken. So of two writers one
wins, readers always find the last whole version, and a writer that dies leaves only data that
nothing names.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.files import content_digest

#: The largest version, and why a save is refused.
LAST = 2**53 - 1
INVALID, SOURCE_CONFLICT, VERSION_CONFLICT = "version_invalid", "source_conflict", "version_conflict"


class Versions:
    """Tables under ``path``: versions from 1, 0 before the first. Old versions stay readable."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _all(self) -> dict[int, dict]:
        try:
            rows = self.spark.read.text(f"{self.path}/versions", wholetext=True, pathGlobFilter="v*").select(F.col("_metadata.file_name").alias("name"), "value").collect()
        except AnalysisException:
            return {}
        return {int(r["name"][1:]): json.loads(r["value"]) for r in rows}

    def current(self) -> tuple[int, dict | None]:
        """The last version and what it says: data, digests of its tables, source_revision, saved_at."""
        every = self._all()
        last = max(every, default=0)
        return last, every.get(last)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        every = self._all()
        said = every[max(every) if version is None else version]
        return self.spark.read.parquet(f"{self.path}/data/{said['data']}/{name}")

    def _claim(self, version: int, text: str) -> bool:
        """Make the version's file, with its content, as one step; false if it is there."""
        final = f"{self.path}/versions/v{version:016}"
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        if urlparse(self.path).scheme in ("", "file"):
            final, draft = urlparse(final).path, urlparse(draft).path
            for at in (final, draft):
                os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(draft, "w") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
            try:
                os.link(draft, final)
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
        store = at(draft).getFileSystem(conf)
        store.mkdirs(at(f"{self.path}/versions"))
        out = store.create(at(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(self.path).toUri(), conf).rename(at(draft), at(final), none)
        except Exception as e:
            store.delete(at(draft), False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def save(self, tables: dict[str, DataFrame], expected: int, source_revision: int = 0, now: str = "", ignoring: tuple[str, ...] = (), current_source: int | None = None) -> dict:
        """Save the tables as version ``expected + 1``.

        Returns ok, saved, version and code. Refused are an expected version that is none (version_invalid) or
        not the last one (version_conflict), and a source revision other than ``current_source``
        (source_conflict). Tables equal to the last version's, but for the columns ``ignoring`` and the
        order of rows, are not saved again.
        """
        if not 0 <= expected < LAST:
            return {"ok": False, "saved": False, "version": self.current()[0], "code": INVALID}
        version, said = self.current()
        refused = lambda code: {"ok": False, "saved": False, "version": version, "code": code}
        if current_source is not None and source_revision != current_source:
            return refused(SOURCE_CONFLICT)
        if version != expected:
            return refused(VERSION_CONFLICT)
        digests = {name: content_digest(df.drop(*ignoring)) for name, df in sorted(tables.items())}
        if said is not None and said["digests"] == digests and said["source_revision"] == source_revision:
            return {"ok": True, "saved": False, "version": version, "code": None}
        data = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/data/{data}/{name}")
        text = json.dumps({"data": data, "digests": digests, "source_revision": source_revision, "saved_at": now}, sort_keys=True)
        if not self._claim(expected + 1, text):
            version = self.current()[0]
            return refused(VERSION_CONFLICT)
        return {"ok": True, "saved": True, "version": expected + 1, "code": None}


def record_once(df: DataFrame, path: str, attempt: int = 0, corrections: int = 2) -> int:
    """Record an output once: the same rows again give the recorded version, other rows are refused, as is an attempt beyond ``corrections``."""
    if not 0 <= attempt <= corrections:
        raise ValueError(f"at most {corrections} corrections: {attempt}")
    kept = Versions(df.sparkSession, path)
    done = kept.save({"output": df}, 0)
    if not done["ok"]:
        version, said = kept.current()
        if said["digests"]["output"] != content_digest(df):
            raise ValueError(f"{path} is recorded with other rows")
        return version
    return done["version"]
