"""Counts of k-mers by tasks: the same as by rows of k-mers, and no row for each k-mer of a read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import streaming
from strandloom.functions import seq as S
from strandloom.operators import kmers as N
from strandloom.operators import lsh
from strandloom.plans import catalog

SEQS = ["ACGTNACGTTTGACA", "", None, "ACG", "NNNN", "TTTTTTTTTT", "ACGTACGTACGTACGTACGTAACC" * 3, "GATTACA", "CC"]


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(list(enumerate(SEQS)), "id long, seq string").repartition(2)


@pytest.mark.parametrize("k", [1, 3, 6, 11, 31])
@pytest.mark.parametrize("canonical", [True, False])
@pytest.mark.parametrize("size", [1 << 20, 7])
def test_counts(reads, k, canonical, size, monkeypatch):
    monkeypatch.setattr(lsh, "SLICE_BYTES", size)
    each = reads.select("id", F.explode(S.kmers_forward("seq", k, canonical)).alias("kmer"))
    want = {r.kmer: r["count"] for r in each.groupBy("kmer").count().collect()}
    assert {r.kmer: r.n for r in N.counts(reads, k, canonical).collect()} == want
    want = {r.id: r.n for r in each.groupBy("id").agg(F.count_distinct("kmer").alias("n")).collect()}
    assert {r.id: r.n for r in N.distinct_counts(reads, k, ["id"], canonical).collect()} == want


def test_pieces_of_long_reads(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lsh, "SLICE_BYTES", 7)
    seqs = ["ACGTACGTACGGTTACA", "AC", "", "TTTTTTT", "ACGTNACGTTAACG"]
    got = [x for _, data, offs in N._pieces(pa.array(seqs), 3) for x in N.numbers(data, offs, 3, False)[0].tolist()]
    want = [sum("ACGT".index(c) * 4 ** (2 - p) for p, c in enumerate(s[i : i + 3])) for s in seqs for i in range(len(s) - 2) if "N" not in s[i : i + 3]]
    assert got == want


def test_no_row_for_each_kmer(spark):
    plan = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert all("Generate explode" not in plan(name) for name in ("long_canonical_kmer_count", "long_distinct_kmers"))


def test_a_table_of_words_gives_what_sums_give(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.choice(np.frombuffer(b"ACGTNacgt", np.uint8), 30_000)
    offs = np.array([0, 0, 5, 9_000, 9_004, 30_000])
    fitted = lsh.Planes(rng.normal(size=(5, 7)) + 1j * rng.normal(size=(5, 7)), rng.normal(size=7))
    for p in (fitted, catalog.planes()):
        for canonical in (True, False):
            fast = lsh.hash_arrays(data, offs, p, canonical)
            assert "_tables" in p.__dict__
            with monkeypatch.context() as m:
                m.setattr(lsh, "TABLE", 0)
                slow = lsh.hash_arrays(data, offs, p, canonical)
            assert all((a == b).all() for a, b in zip(fast, slow))


def test_streams_count_in_tasks(spark, tmp_path):
    spark.createDataFrame([(s,) for s in SEQS if s], "value string").write.text(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq string").text(str(tmp_path / "in"))
    counts = streaming.word_counts(stream, catalog.planes())
    assert "Generate" not in counts._jdf.queryExecution().analyzed().toString()
    counts.writeStream.outputMode("complete").format("memory").queryName("tasks").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    words = lsh.hash_reads(spark.createDataFrame([(s,) for s in SEQS if s], "seq string"), catalog.planes(), [])
    want = {r.word: r["count"] for r in words.select(F.explode("words").alias("word")).groupBy("word").count().collect()}
    assert {r.word: r.n for r in spark.table("tasks").collect()} == want


def test_letters_of_texts(spark):
    texts = [(0, "Az\n bé-ß€Zy😀a"), (1, None), (2, ""), (3, "123"), (4, "\n\nabc")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(1)
    want = df.select("id", F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z\n]", ""), catalog.LETTERS, catalog.BASES).alias("seq"))
    assert sorted(N.lettered(df, ["id"], "text", catalog.LETTERS, catalog.BASES).collect()) == sorted(want.collect())
    assert "regexp_replace" not in catalog.long_reads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
