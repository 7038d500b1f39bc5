"""Every query of the catalogue against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from zonalis.plans.catalog import QUERIES
from zonalis.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    mine = sorted([plain(r[c]) for c in order] for r in got.collect())
    theirs = sorted([plain(dict(zip(want.columns, r))[c]) for c in order] for r in want.fetchall())
    assert len(mine) == len(theirs) > 0
    assert mine == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
