"""Each query against its SQL at the smallest size."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(set(entry.QUERIES)))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    sql = entry.oracle_sql()[name]
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
