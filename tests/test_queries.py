"""Every document query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from foliospark.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "lineitem", "orders"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    frame = queries.queries()[name](spark, SF)
    sql = duck.sql(oracles.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(sql.columns)
    ours = sorted([plain(r[c]) for c in columns] for r in frame.collect())
    at = [sql.columns.index(c) for c in columns]
    theirs = sorted([plain(r[i]) for i in at] for r in sql.fetchall())
    assert ours == theirs


def test_every_query_has_sql():
    assert set(queries.queries()) - set(oracles.oracle_sql()) == {"text_blocks"}
