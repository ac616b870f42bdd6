"""Every drawing query with oracle SQL, and its SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sheetloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def cell(v):
    """Values that compare alike: numbers as floats, nested values and all others as text with floats to six digits."""
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(f"{x:.6g}" if isinstance(x, float) else x for x in map(cell, v)) + "]"
    try:
        return float(v)
    except (TypeError, ValueError):
        return str(v)


def ordered(rows):
    """Rows sorted by their text and whole numbers first, so that the last digits of sums don't decide."""
    exact = lambda x: not isinstance(x, float) or x.is_integer()
    return sorted(rows, key=lambda r: ([(isinstance(x, float), str(x)) for x in r if exact(x)], [x for x in r if not exact(x)]))


def alike(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    ours = ordered([cell(r[c]) for c in sorted(names)] for r in got.collect())
    theirs = ordered([cell(r[names.index(c)]) for c in sorted(names)] for r in want.fetchall())
    assert len(ours) == len(theirs)
    assert not [(a, b) for a, b in zip(ours, theirs, strict=True) if not all(map(alike, a, b))][:3]
