"""Every registered engine query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tickloom.plans import queries
from tickloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    mine = sorted(tuple(map(plain, row)) for row in found.select(*[f"`{c}`" for c in columns]).collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(tuple(map(plain, row)) for row in db.sql(f"SELECT {listed} FROM ({ORACLES[name]})").fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, monkeypatch, name):
    monkeypatch.setattr(queries, "SIMULATIONS", 200)
    assert QUERIES[name](spark, SF).count() > 0
