"""Every query that has SQL gives the rows that DuckDB finds."""

import datetime

import duckdb
import pytest

from logweave import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in queries.SQL:
        assert rows
        return
    got = db.execute(queries.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall()), key=str)
    have = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
    assert have == want
