"""Every registered query of the engine against its SQL in DuckDB."""

import datetime
import os

import duckdb
import pytest

from noteloom.plans import queries as base

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(base.ORACLE))
def test_same_rows(spark, duck, name):
    df = base.QUERIES[name](spark, SF)
    want = duck.execute(base.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, want.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.ORACLE)))
def test_runs(spark, name):
    assert base.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert base.flagship(spark, SF).count() > 0
