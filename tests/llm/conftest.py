import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType())])


@pytest.fixture
def docs_of(spark):
    """DataFrame of documents from (doc_id, text[, source[, lang]]), with extra columns whose names operators use themselves."""

    def make(rows, extra=False, parts=3):
        rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for c in ("size", "shard", "slot", "n_words", "_text", "_host", "_row", "id", "key", "mark", "ids", "grade", "hit_spans", "component", "n", "sig", "_o"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make


LONG = "lorem ipsum " * 40_000


@pytest.fixture
def awkward():
    """Nulls in each column, empty and very long texts, ties and repeated rows."""
    same = " ".join(f"w{i}" for i in range(60))
    return [(1, None, None, None), (2, "", "a", "en"), (3, LONG, "a", None), (4, same, "a", "en"), (5, same, "b", "en"), (5, same, "b", "en"), (None, "no id", "b", "en"), (7, "  \n\t ", "", "en"), (8, "x", None, "en")]
