"""Steps by blocks in bounded memory: in the task that has the reads where the model is small, else from small row groups."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandloom.operators import blocks as B
from strandloom.operators import kmers as N
from strandloom.operators import lsh
from strandloom.plans import catalog
from strandloom.storage import local

SF = "/root/testdata/sf0.001"
READS = [(1, [1, 2, 3, 1, 2, 0, 0, 4]), (2, []), (3, None), (4, [5]), (5, [2, 2, 2, 2, 1]), (6, list(range(6)) * 9), (7, [3, 4])]


def rows_of(spark, parts=2):
    return spark.createDataFrame(READS, "read long, words array<long>").repartition(parts, "read")


def params_of(spark, n=6, dim=3):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=dim).tolist(), rng.normal(size=dim).tolist()) for i in range(n)]
    return B.Params.create(spark.createDataFrame(rows, "word long, wi array<double>, wo array<double>"), dim, 2)


def result(step):
    new, losses = step
    return sorted((r.word, *r.wi, *r.wo) for r in new.table().collect()), B.mean_loss(losses).first()


@pytest.mark.parametrize("positions", [8192, 7])
@pytest.mark.parametrize("exact, skipgram, mean", [(True, False, False), (True, True, True), (False, False, True)])
def test_all_ways_give_one_step(spark, monkeypatch, positions, exact, skipgram, mean):
    monkeypatch.setattr(B, "POSITIONS", positions)
    params, s = params_of(spark), B.Step(0.2, 2, 3, B.hashed_draw(6, 2, 1, 0), skipgram, exact, mean)
    made = lambda batches: (b.set_column(1, "words", pa.array([[w for w in x or []] for x in b.column(1).to_pylist()], pa.list_(pa.int64()))) for b in batches)
    found = [result(params.step(B.kept(B.pack(rows_of(spark), 3)), s)), result(params.step_of_reads(rows_of(spark), s)), result(params.step_of_reads(rows_of(spark), s, made=made))]
    monkeypatch.setattr(B, "SHARED_FLOATS", 0)
    found += [result(params.step_of_reads(rows_of(spark), s)), result(params.step_of_reads(rows_of(spark), s, made=made))]
    for model, (loss, reads) in found[1:]:
        assert np.allclose(model, found[0][0], atol=1e-8) and (loss, reads) == (pytest.approx(found[0][1].loss), 7)


def test_reads_of_one_step_are_not_stored_as_blocks(spark, monkeypatch):
    """Blocks of 64 KB of words each were stored, read by the thousand and shuffled; an executor of 3000 MB could not hold them."""
    monkeypatch.setattr(B, "pack", None)
    assert catalog.long_sgns_step(spark, SF).count() == 64


def test_stored_blocks_have_small_row_groups(spark):
    """Spark's reader makes up to 4,096 rows of a row group at once."""
    reads = spark.range(150).coalesce(1).select(F.col("id").alias("read"), F.transform(F.sequence(F.lit(0), F.lit(8191)), lambda i: i % 5).alias("words"))
    blocks = B.kept(B.pack(reads, 3))
    groups = [m.row_group(i).num_rows for f in blocks.inputFiles() for m in [pq.ParquetFile(local(f)).metadata] for i in range(m.num_row_groups)]
    assert sum(groups) == 150 and max(groups) <= 64


def test_letters_are_made_by_slices(monkeypatch):
    monkeypatch.setattr(lsh, "SLICE_BYTES", 100)
    texts = ["ab-c", None, "", "x" * 250, *["d e"] * 90]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "_text"]).slice(1)
    made = list(N.letter_batches(catalog.LETTERS, catalog.BASES)(iter([batch])))
    assert len(made) >= 4 and all(pa.compute.sum(pa.compute.binary_length(b.column(1))).as_py() <= 250 for b in made)
    table = str.maketrans(catalog.LETTERS, catalog.BASES)
    want = [(i, "".join(c for c in t or "" if c in catalog.LETTERS).translate(table)) for i, t in enumerate(texts)][1:]
    assert [(r["id"], r["seq"]) for b in made for r in b.to_pylist()] == want


def block_of(reads, half_window, skipgram):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(reads))), pa.array(reads, pa.list_(pa.int64()))], names=["read", "words"])
    return [B._Block(row, half_window, skipgram) for b in B._packed(half_window)(iter([batch])) for row in B._rows(b)]


@pytest.mark.parametrize("skipgram", [False, True])
@pytest.mark.parametrize("n, half_window", [(1, 3), (2, 1), (2, 4), (5, 2), (16, 3), (64, 3)])
def test_pairs_of_words_give_the_kernels_moves(monkeypatch, n, half_window, skipgram):
    monkeypatch.setattr(B, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(B, "POSITIONS", 50)
    rng = np.random.default_rng(n)
    wi, wo = rng.normal(size=(2, n, 3))
    draw = lambda read, pos, part, center: (read[:, None] * 7 + pos[:, None] * 3 + part[:, None] + np.arange(4)) % n
    s = B.Step(0.1, 4, half_window, draw, skipgram, exact_sigmoid=True)
    blocks = block_of([rng.integers(n, size=k).tolist() for k in (0, 1, 2, 3, 4, 5, 9, 33, 170)], half_window, skipgram)
    assert len(blocks) > 3
    for block in blocks:
        got = B._by_pairs(block, np.arange(n), wi, wo, s)
        with monkeypatch.context() as m:
            m.setattr(B, "PAIRS", 0)
            want = B.kernel(block, np.arange(n), wi, wo, s)
        assert all(np.allclose(a, b, rtol=1e-12, atol=1e-12) for a, b in zip(got, want))
        assert B._by_pairs(block, np.arange(n), wi * 1e6, wo, s) is None


def test_reads_without_words_end_a_block(monkeypatch):
    monkeypatch.setattr(B, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(B, "POSITIONS", 10)
    assert [len(b.row["read"]) for b in block_of([[]] * 25, 3, False)] == [10, 10, 5]


def test_words_that_the_model_lacks():
    for known in (np.arange(4), np.array([0, 1, 2, 9]), np.array([1, 1 << 40]), np.zeros(0, np.int64)):
        for word in (-1, 5, 1 << 50):
            with pytest.raises(ValueError, match=f"no vector for word {word}"):
                B._places(known, np.array([*known[:2], word]))


def test_a_word_without_vector_ends_the_step(spark):
    with pytest.raises(Exception, match="no vector for word 5"):
        params_of(spark, n=5).step_of_reads(rows_of(spark), B.Step(0.1, 2, 3, B.hashed_draw(5, 2, 1, 0)))


def test_congruent_draws():
    read, pos, center = np.array([0, 7, 50_000_000, -3]), np.array([0, 5, 100_000, 1]), np.array([0, 1, 15, 7])
    got = B.congruent_draw(16, 3, lambda r, p: r * 1000 + p)(read, pos, None, center)
    for row, r, p, c in zip(got.tolist(), read.tolist(), pos.tolist(), center.tolist()):
        drawn = [((r * 1000 + p) * 1103515245 + 12345 * (i + 1)) % 2147483648 % 15 for i in range(3)]
        assert row == [d + (d >= c) for d in drawn]
