"""Every query with SQL gives what its SQL gives, on the smallest tables."""

import duckdb
import pytest

import lantern.plans.base as base
import __spark_entry__  # noqa: F401  registers the plans


def plain(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    db.sql("set timezone='UTC'")
    for t in base.TABLES:
        db.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_same_as_sql(spark, small, duck, name):
    found = base.QUERIES[name](spark, small)
    columns = sorted(found.columns)
    here = plain(tuple(r) for r in found.select(*columns).collect())
    there = duck.sql(base.SQL[name])
    order = sorted(range(len(there.columns)), key=lambda i: there.columns[i])
    assert sorted(there.columns) == columns
    assert here == plain(tuple(r[i] for i in order) for r in there.fetchall())


def test_names_match():
    assert set(base.SQL) <= set(base.QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
