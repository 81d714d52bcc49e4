"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from sigloom import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None or type(value).__name__ == "NAType" or value != value:
        return "null"
    if isinstance(value, (bool, int, float)) or type(value).__module__ == "numpy":
        return float(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, DATA).toPandas()
    if name not in plans.oracles():
        assert len(got) > 0
        return
    want = duck.execute(plans.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a, b = (sorted((tuple(map(plain, r)) for r in x[order].itertuples(index=False)), key=repr) for x in (got, want))
    assert len(a) == len(b)
    loose = lambda x, y: x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-4, abs_tol=2e-5)
    assert all(loose(x, y) for r, s in zip(a, b) for x, y in zip(r, s))
