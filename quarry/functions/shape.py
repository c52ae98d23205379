"""Shapes of JSON values, said once and checked whole: every fault as (path, code), in the order of the shape.

A shape is data: kinds of values, bounds, fields that must or may be there, what must differ among
the elements of a list. Values of unknown depth and of any type go to Python in Arrow batches, each
row on its own; repeated keys are faults, as in ``canonical``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.canonical import SAFE_INTEGER, Refused, read

Fault = tuple[str, str]


@dataclass(frozen=True)
class Text:
    """A string that is not blank, of at most ``most`` code points; one of ``among`` or like ``pattern`` if those are given."""

    most: int = 1_000_000
    blank: bool = False
    among: tuple[str, ...] = ()
    pattern: str = ""

    def faults(self, value: object, path: str) -> Iterator[Fault]:
        if not isinstance(value, str):
            yield path, "not_text"
        elif not self.blank and not value.strip():
            yield path, "blank"
        elif len(value) > self.most:
            yield path, "too_long"
        elif self.among and value not in self.among:
            yield path, "not_allowed"
        elif self.pattern and not re.fullmatch(self.pattern, value):
            yield path, "form"


@dataclass(frozen=True)
class Whole:
    """A whole number from ``least`` on, exact in every reader; 2.0 is whole."""

    least: int = 0

    def faults(self, value: object, path: str) -> Iterator[Fault]:
        if isinstance(value, bool) or not isinstance(value, int | float) or value != int(value):
            yield path, "not_whole"
        elif not self.least <= value <= SAFE_INTEGER:
            yield path, "out_of_range"


@dataclass(frozen=True)
class Each:
    """A list of ``of``, from ``least`` to ``most`` elements, which differ by ``key``."""

    of: object
    least: int = 0
    most: int = 1_000_000
    key: Callable[[object], object] | None = None

    def faults(self, value: object, path: str) -> Iterator[Fault]:
        if not isinstance(value, list):
            yield path, "not_list"
            return
        if not self.least <= len(value) <= self.most:
            yield path, "length"
        found = [f for i, x in enumerate(value) for f in self.of.faults(x, f"{path}[{i}]")]
        yield from found
        # keys of elements that have their shape
        if self.key and not found and len({self.key(x) for x in value}) < len(value):
            yield path, "repeated"


@dataclass(frozen=True)
class Fields:
    """An object with the fields of ``must``, maybe those of ``may``, and no others; ``also`` are rules over a value whose fields have their shapes."""

    must: dict[str, object]
    may: dict[str, object] = field(default_factory=dict)
    also: tuple[Callable[[dict], Iterator[Fault]], ...] = ()

    def faults(self, value: object, path: str) -> Iterator[Fault]:
        if not isinstance(value, dict):
            yield path, "not_object"
            return
        for k in value:
            if k not in self.must and k not in self.may:
                yield f"{path}.{k}", "unknown_field"
        clean = True
        for k, shape in {**self.must, **self.may}.items():
            if k in value:
                for f in shape.faults(value[k], f"{path}.{k}"):
                    clean = False
                    yield f
            elif k in self.must:
                clean = False
                yield f"{path}.{k}", "missing"
        if clean:
            for rule in self.also:
                yield from ((f"{path}{p}", code) for p, code in rule(value))


def faults_of(text: str | None, shape: object, prefix: str = "") -> list[dict] | None:
    """All faults of a text of ``prefix`` and JSON; none of a null text."""
    if text is None:
        return None
    if not text.startswith(prefix):
        return [{"path": "$", "code": "prefix"}]
    try:
        return [{"path": p, "code": c} for p, c in shape.faults(read(text[len(prefix) :]), "$")]
    except Refused as e:
        return [{"path": "$", "code": str(e)}]
    except (RecursionError, OverflowError):
        return [{"path": "$", "code": "too_deep"}]


def faults(text: Column, shape: object, prefix: str = "") -> Column:
    """The faults of each text as an array of (path, code), the first that counts first; empty where the text has the shape, null where it is null."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([faults_of(t, shape, prefix) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<struct<path:string,code:string>>")(text)
