"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import math
from pathlib import Path

import duckdb
import pytest

from spanloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 5) + 0.0
    return str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = df.collect()
    if name not in catalog.ORACLES:
        return
    said = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(said.columns)
    assert rows(df.columns, found) == rows(said.columns, said.fetchall())
