"""Every query against its SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from cytolake.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def rows(df, columns):
    return sorted((tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    a, b = rows(ours, columns), rows(theirs, columns)
    assert len(a) == len(b)
    close = lambda x, y: x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-4, abs_tol=2e-4)
    assert all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
