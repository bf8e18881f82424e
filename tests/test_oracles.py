"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from kinloom.oracles import ORACLES
from kinloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    return float(f"{value:.9g}") + 0.0 if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(map(normal, r))) for r in df.select(*cols).collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(normal(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    if os.environ.get("QUICK"):
        pytest.skip("slow")
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
