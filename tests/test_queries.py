"""Every query with SQL gives the SQL's rows; the others give rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from cohortspark.plans import all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.7g}"
    return "null" if v is None else str(v)


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in at) for r in values)


@pytest.mark.parametrize("name", sorted(all_queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    found = all_queries.QUERIES[name](spark, SF)
    want = duck.execute(all_queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - set(all_queries.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert all_queries.QUERIES[name](spark, SF).count() > 0
