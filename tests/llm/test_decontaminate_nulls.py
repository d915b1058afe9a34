import duckdb

from strandloom.llm import decontaminate


def test_items_without_an_id_are_searched(spark, docs_of, tmp_path):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = docs_of([(1, f"so {passage} it was"), (2, f"{passage} lorem"), (3, "nothing"), (4, "lorem")])
    items = spark.createDataFrame([(None, passage), (None, "ipsum"), ("7", "lorem")], "item_id string, text string")
    by = {r.doc_id: r for r in decontaminate.find(docs, items).collect()}
    assert [tuple(s) for s in by[1].hit_spans] == [(1, 13)] and by[1].hit_items == []
    assert by[2].hit_items == ["7"] and len(by[2].hit_spans) == 1 and not by[3].hit_spans
    for name, df in (("documents", docs), ("benchmark", items)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(decontaminate.ORACLE)
    got = decontaminate.op9(spark, str(tmp_path)).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
