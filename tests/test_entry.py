"""The driver contract: every registered query against its SQL."""

import os
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def names():
    from tidelog.plans.catalog import SQL

    return sorted(SQL)


@pytest.fixture(scope="module")
def duck():
    c = pytest.importorskip("duckdb").connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
