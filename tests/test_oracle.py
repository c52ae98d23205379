"""Every query with SQL against DuckDB, over the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quarry.plans import registry


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, data, name):
    db = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    db.execute("set timezone = 'UTC'")
    want = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = registry.queries()[name](spark, data)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql_runs(spark, data, name):
    assert registry.queries()[name](spark, data).columns
