"""Steps that once had a row or a group for each place or draw: the same results in fewer."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import edges as E
from strandloom.operators import lsh
from strandloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_context_sums_need_no_lambda(spark):
    assert "lambda" not in plan(catalog.long_cbow_context(spark, SF))


def test_joined_hashes_group_distinct_kmers(spark):
    df = spark.createDataFrame([(1, 0, "ACGTAC"), (1, 1, "ACGTAC"), (2, 0, "TTTTTT"), (2, 1, "ACGTN"), (3, 0, None)], "id long, pos int, kmer string")
    got = lsh.hash_joined(df, catalog.planes(), ["id", "pos"])
    aggregates = [line for line in plan(got).splitlines() if "Aggregate(keys" in line]
    assert aggregates and not any("pos#" in line.split("functions")[0].replace("_pos#", "") for line in aggregates)
    want = df.where("length(kmer) = 6").select("id", "pos", lsh.lsh_hash("kmer", catalog.planes()).alias("word"))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("size", [1 << 16, 7])
@pytest.mark.parametrize("degree", [0, 3, 4])
def test_read_edges(spark, monkeypatch, size, degree):
    monkeypatch.setattr(E, "DRAWS", size)
    rows = [(i, [(i * 7 + j * j) % 11 for j in range(i)]) for i in range(9)] + [(20, None), (None, [1, 2, 3, 4, 5, 6])]
    df = spark.createDataFrame(rows, "id long, words array<long>").repartition(2)
    want = df.select("id", F.explode(E.generate_edges("words", degree, F.col("id"), seed=5)).alias("e")).select("id", "e.src", "e.dst")
    assert sorted(map(str, E.read_edges(df, degree, ["id"], seed=5).collect())) == sorted(map(str, want.collect()))


def test_draws_are_no_array_functions(spark):
    assert "conv(" not in plan(catalog.generate_edges_capped(spark, SF))


@pytest.mark.parametrize("held", [1 << 16, 6])
def test_shared_edges_draw_in_place(spark, monkeypatch, held):
    monkeypatch.setattr(E, "HELD", held)
    rows = [(r, k) for k, n in (("AAA", 2), ("CCC", 5), ("GGG", 6), ("TTT", 40)) for r in range(n)]
    df = spark.createDataFrame(rows, "read long, kmer string")
    got = E.shared_kmer_edges(df, 4)
    numbered = E.numbered(df)
    pairs = {(a, b) for n in (2,) for a in range(n) for b in range(a + 1, n)}
    drawn = E.drawn_edges(numbered.where("n > 4"), 4).select(F.least("src", "dst").alias("s"), F.greatest("src", "dst").alias("d"))
    assert sorted((r.src, r.dst) for r in got.collect()) == sorted(pairs | {(r.s, r.d) for r in drawn.collect()})
    assert held == 6 or "MapInArrow" in plan(got)


def test_places_of_words():
    import numpy as np

    from strandloom.operators import blocks as B

    for words in (np.array([5, 3, 5, 0, 9]), np.array([1 << 30, 7, 7]), np.array([-2, 4]), np.zeros(0, np.int64)):
        known = np.unique(words)
        assert (B._distinct(words) == known).all() and (B._places(known, words) == np.searchsorted(known, words)).all()
