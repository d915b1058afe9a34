import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if n.startswith("op")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if "doc_id" in df.columns:
        assert len(rows) == 200 and len({r.doc_id for r in rows}) == 200
    if sql := entry.oracle_sql().get(name):
        want = duck.sql(sql)
        assert sorted(want.columns) == sorted(df.columns)
        cols = sorted(df.columns)
        assert sorted((tuple(r[c] for c in cols) for r in rows), key=str) == sorted((tuple(dict(zip(want.columns, r))[c] for c in cols) for r in want.fetchall()), key=str)
