"""Every query that has SQL gives the rows that DuckDB gives; the others run and keep their schema."""

import duckdb
import pytest
from loomstone.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_equals_duckdb(spark, sf, duck, name):
    df = q.QUERIES[name](spark, sf)
    cur = duck.execute(q.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, sf, name):
    df = q.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())
