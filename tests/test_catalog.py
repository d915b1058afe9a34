import math

import duckdb
import pytest

import __spark_entry__ as entry
from strandloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 5) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if sql := catalog.ORACLE.get(name):
        want = duck.sql(sql)
        cols = sorted(df.columns)
        assert sorted(want.columns) == cols
        expected = [dict(zip(want.columns, r)) for r in want.fetchall()]
        assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr) == sorted((tuple(plain(r[c]) for c in cols) for r in expected), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
