"""Every core query with SQL, on the smallest tables, against DuckDB."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from corpuslens.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    at = [cols.index(c) for c in sorted(cols)]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)


# Rows of the queries that SQL can't express, where they follow from the tables; the operators have tests of their own.
def _count(duck, sql):
    return duck.execute(sql).fetchone()[0]


IDS = "(SELECT count(DISTINCT id) FROM hadiths WHERE id IS NOT NULL)"
QUERY_IDS = "(SELECT count(DISTINCT id) FROM cases WHERE id IS NOT NULL)"
PAIRS = "(SELECT count(DISTINCT (c.id, r)) FROM (SELECT id, unnest(relevant) AS r FROM cases) c WHERE r IN (SELECT id FROM hadiths))"
LINES = {
    "verdict_states": QUERY_IDS, "tagged_words": "(SELECT count(DISTINCT id) FROM hadiths WHERE trim(isnad) <> '')", "sentence_facts": IDS, "case_sources": PAIRS, "word_diffs": PAIRS,
    "completed_chains": "(SELECT count(*) FROM (SELECT DISTINCT id, route_no FROM routes WHERE id IS NOT NULL AND name IS NOT NULL))",
    "spelling_cases": None, "search_metrics": None, "verdict_metrics": None,
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_whole_and_stable(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows and len(df.columns) == len(set(df.columns)) and all(any(v is not None for v in r) for r in rows)
    if LINES.get(name):
        assert len(rows) == _count(duck, f"SELECT {LINES[name]}")
    assert rows == sorted(map(tuple, QUERIES[name](spark, DATA).repartition(3).collect()), key=str)
