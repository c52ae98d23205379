"""Known fragments in texts: where each stands, and texts or nested values without them.

A roster of fragments is cut to chunks of bounded size; each chunk is one automaton, broadcast,
through which a text passes once, whatever the number of fragments. Texts are not joined with
the roster.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as words
from quarry.operators.groups import in_batches
from quarry.sources.work import written

#: Characters of fragments in a chunk: an automaton of that many letters takes some hundred MB at most in a worker.
CHUNK = 4_000_000
Hit = tuple[int, int, int]


def chunks(roster: DataFrame) -> list[Broadcast]:
    """The roster (fragment_id, fragment, category) in broadcasts of bounded size; empty and null fragments are none, of equal ones the smallest id counts."""
    spark = roster.sparkSession
    rows = roster.filter("fragment <> ''").groupBy("fragment").agg(F.min_by(F.struct("fragment_id", "category"), "fragment_id").alias("of"))
    rows = rows.select(F.col("of.fragment_id").cast("long").alias("fragment_id"), "fragment", words.safe_category(F.coalesce("of.category", F.lit(""))).alias("category"))
    total = rows.agg(F.sum(F.length("fragment"))).first()[0] or 0
    n = int(total // CHUNK) + 1
    # by digest, so that chunks are even; each is collected alone
    dealt = written(rows.withColumn("chunk", F.pmod(F.xxhash64("fragment"), F.lit(n))), "roster") if n > 1 else rows.withColumn("chunk", F.lit(0))
    return [spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in dealt.filter(F.col("chunk") == k).select("fragment_id", "fragment", "category").collect()])) for k in range(n)]


#: A worker's last automaton, by its chunk: built once, not for every batch.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(chunk: Broadcast) -> ahocorasick.Automaton | None:
    name, rows = chunk.value
    if name not in _BUILT:
        made = ahocorasick.Automaton()
        for i, (_, fragment, _) in enumerate(rows):
            made.add_word(fragment, (i, len(fragment)))
        made.make_automaton()
        _BUILT.clear()
        _BUILT[name] = made
    return _BUILT[name] if rows else None


def _hits(chunk: Broadcast, text: str) -> Iterator[Hit]:
    """(start, end, place in the chunk) of every occurrence, overlapping ones too."""
    found = _automaton(chunk)
    if found is not None and text:
        for last, (i, n) in found.iter(text):
            yield last + 1 - n, last + 1, i


def occurrences(texts: DataFrame, roster: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fragment_id, start, end): every place where a fragment stands in a text, in code points, overlapping ones too."""
    schema, every = "id long, fragment_id long, start int, end int", None
    held = chunks(roster)
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # every chunk reads the texts: what made them is not done again for each
    rows = written(rows, "texts") if len(held) > 1 else rows
    for chunk in held:

        def run(batches: Iterator[pd.DataFrame], chunk: Broadcast = chunk) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(i, chunk.value[1][k][0], s, e) for i, t in zip(batch["id"], batch["text"], strict=True) for s, e, k in _hits(chunk, t or "")]
                yield pd.DataFrame(rows, columns=["id", "fragment_id", "start", "end"])

        found = in_batches(rows).mapInPandas(run, schema)
        every = found if every is None else every.unionByName(found)
    return every


def _cut(text: str, hits: list[tuple[int, int, str]]) -> str:
    """The text with each fragment as a tag: the leftmost first, the longest of those, none within another."""
    pieces, at = [], 0
    for s, e, category in sorted(hits, key=lambda h: (h[0], -h[1])):
        if s >= at:
            pieces += [text[at:s], f'<redacted category="{category}"/>']
            at = e
    return "".join([*pieces, text[at:]])


def redactor(roster: DataFrame) -> Callable[[Column], Column]:
    """Of an array of strings the array with all fragments as tags; nulls stay."""
    held = chunks(roster)

    def run(columns: pd.Series) -> pd.Series:
        rows = [[] if strings is None else list(strings) for strings in columns]
        found: dict[tuple[int, int], list] = {}
        # chunk by chunk: a worker holds one automaton at a time
        for chunk in held:
            for r, strings in enumerate(rows):
                for k, t in enumerate(strings):
                    if t and (hits := [(s, e, chunk.value[1][i][2]) for s, e, i in _hits(chunk, t)]):
                        found.setdefault((r, k), []).extend(hits)
        return pd.Series([None if strings is None else [_cut(t, found[r, k]) if (r, k) in found else t for k, t in enumerate(rows[r])] for r, strings in enumerate(columns)], dtype=object)

    return lambda strings: F.pandas_udf(run, "array<string>")(strings)


def redacted(texts: DataFrame, roster: DataFrame, text_col: str, into: str) -> DataFrame:
    """The rows with ``into``: the text without the roster's fragments."""
    take = redactor(roster)
    in_batches(texts)
    return texts.withColumn(into, F.get(take(F.array(text_col)), F.lit(0)))


def _strings(value: Column, kind: T.DataType) -> Column | None:
    """All strings of a nested value as one array, keys of maps aside; None where the type has none."""
    if isinstance(kind, T.StringType):
        return F.array(value)
    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := _strings(value[f.name], f.dataType)) is not None]
        return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]) if parts else None
    if isinstance(kind, T.MapType):
        return _strings(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType) and _strings(F.lit(None), kind.elementType) is not None:
        return F.flatten(F.transform(value, lambda x: F.coalesce(_strings(x, kind.elementType), F.array().cast("array<string>"))))
    return None


def _made(value: Column, kind: T.DataType, look: Callable[[Column], Column]) -> Column:
    """The value again, each string looked up."""
    if isinstance(kind, T.StringType):
        return look(value)
    if isinstance(kind, T.StructType):
        made = F.struct(*[_made(value[f.name], f.dataType, look).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _made(x, kind.elementType, look))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _made(x, kind.valueType, look))
    return value


def redacted_value(df: DataFrame, roster: DataFrame, column: str) -> DataFrame:
    """The rows with every string of ``column``, at any depth of structs, arrays and maps, without the roster's fragments.

    The value's type says where strings are: they leave the row as one array and come back by a map,
    so that the value itself is rebuilt without leaving the engine. Keys of maps and all else stay.
    """
    kind = df.schema[column].dataType
    strings = _strings(F.col(column), kind)
    if strings is None:
        return df
    take = redactor(roster)
    in_batches(df)
    said = F.array_distinct(F.filter(strings, lambda x: x.isNotNull()))
    both = df.withColumn("__said", F.coalesce(said, F.array().cast("array<string>"))).withColumn("__kept", take(F.col("__said")))
    look = lambda x: F.element_at(F.map_from_arrays("__said", "__kept"), x)
    return both.withColumn(column, _made(F.col(column), kind, look)).drop("__said", "__kept")
