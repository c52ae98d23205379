"""Folds over groups whose result depends on the order of their rows: many small groups to one step in Python.

Rows are dealt out and sorted by their group, and a worker walks them batch by batch. It holds one
batch and the group that runs over its end, so that neither the number of groups nor of rows counts,
and no group pays for a call of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20

KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def in_batches(df: DataFrame) -> DataFrame:
    """The rows, for a step in Python: the session's bound on the bytes of a batch is lowered if it is larger."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", conf.get(key))) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def walked(batches: Iterable[pa.RecordBatch], fold: Callable[[object, list[tuple]], Iterable[tuple]]) -> Iterator[list[tuple]]:
    """What ``fold`` makes of each group (first column) of sorted rows, batch by batch."""
    last, held = None, []
    for batch in batches:
        out = []
        columns = [c.to_pandas(integer_object_nulls=True).tolist() for c in batch.columns]
        for key, rows in groupby(zip(*columns, strict=True), itemgetter(0)):
            if held and key != last:
                out.extend(fold(last, held))
                held = []
            last = key
            held.extend(rows)
        yield out
    if held:
        yield list(fold(last, held))


def folded(rows: DataFrame, key: str, fold: Callable[[object, list[tuple]], Iterable[tuple]], schema: str, order: tuple = ()) -> DataFrame:
    """The rows that ``fold`` makes of each group: it is given the group's ``key`` and all its rows (tuples of the columns, ``key`` first), by ``order``.

    ``schema`` is "name kind, ..." of long, int, string and boolean; rows without key are left out.
    """
    made = pa.schema([(name, KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in walked(batches, fold):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), made, strict=True)], schema=made)

    rest = [c for c in rows.columns if c != key]
    dealt = rows.filter(f"{key} is not null").select(key, *rest).repartition(key).sortWithinPartitions(key, *order)
    return in_batches(dealt).mapInArrow(run, schema)
