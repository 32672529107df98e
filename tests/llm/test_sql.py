"""Queries of this subpackage against DuckDB, which works from the definitions."""

import glob
from pathlib import Path

import duckdb
import pytest

from corpuslens.llm.queries import QUERIES
from corpuslens.llm.sql import SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    at = [cols.index(c) for c in sorted(cols)]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
