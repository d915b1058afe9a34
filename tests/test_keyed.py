"""Draws, samples, fits and sums that come out the same on each retry, machine and partitioning."""

import hashlib
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import vec as V
from strandloom.operators import edges as E
from strandloom.operators import lsh
from strandloom.plans.catalog import planes


def key(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("shares, parts", [(4096, 1), (3, 4)])
def test_holders_are_numbered_without_gaps(spark, monkeypatch, shares, parts):
    monkeypatch.setattr(E, "SHARES", shares)
    held = spark.createDataFrame([(i, k) for i in range(500) for k in ("hot", f"k{i % 90}")], "read long, kmer string").repartition(parts)
    got = defaultdict(dict)
    for r in E.numbered(held).collect():
        got[r.kmer][r.number] = (r.read, r.n)
    assert len(got["hot"]) == 500 and all(sorted(v) == list(range(len(v))) and {n for _, n in v.values()} == {len(v)} for v in got.values())
    order = sorted(range(500), key=lambda i: (key(0, 0, i) % shares, i))
    assert [got["hot"][i][0] for i in range(500)] == order


@pytest.mark.parametrize("degree", [6, 7, 1])
def test_draws_of_a_hot_group(spark, degree):
    """As many draws as asked for, with replacement, each of two reads by key; nothing depends on the group's size."""
    held = spark.createDataFrame([(i, "hot") for i in range(301)] + [(i, "few") for i in range(3)], "read long, kmer string")
    holders = E.numbered(held).where("kmer = 'hot'")
    read = {r.number: r.read for r in holders.collect()}
    rows = E.drawn_edges(holders, degree, seed=5).collect()
    draws = math.ceil(degree * 301 / 2)
    want = [(t, read[u], read[v]) for t in range(draws) for u, v in [(key(5, 0, "hot", t, 0) % 301, key(5, 0, "hot", t, 1) % 301)] if u != v]
    assert sorted((r.draw, r.src, r.dst) for r in rows) == want and draws - 10 < len(want) <= draws
    if degree > 1:
        ends = Counter(x for _, *e in want for x in e)
        assert len(ends) > 290 and max(ends.values()) < 6 * degree


def test_no_list_or_task_holds_a_hot_group(spark, monkeypatch):
    """Neither a collected list over the bound, nor a draw made by one row for all."""
    held = spark.range(2000).select(F.col("id").alias("read"), F.lit("hot").alias("kmer"))
    monkeypatch.setattr(E, "SHARES", 50)
    plan = E.drawn_edges(E.numbered(held), 10)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and plan.count("generate explode(sequence") + plan.count("Generate explode(sequence") > 0
    assert 9900 < E.drawn_edges(E.numbered(held), 10).count() <= 10000


def reads_of(spark, parts=3):
    rows = [(i, "ACGTTGCATTGACCA"[i % 7 :] + "ACG" * (i % 5 + 1)) for i in range(400)] + [(900, "NNNNNNNNNN"), (901, "ACGTA"), (902, None), (903, "")]
    return spark.createDataFrame(rows, "id long, seq string").repartition(parts)


def test_samples_do_not_depend_on_partitions(spark):
    got = [[(r.key, r.kmer) for r in lsh.sampled(reads_of(spark, p), 5, 40, seed=2, keys=["id"]).collect()] for p in (1, 3, 8)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 40 and got[0] == sorted(got[0])
    seqs = {r.id: r.seq for r in reads_of(spark).collect() if r.seq and len(r.seq) > 5}
    flip = str.maketrans("ACGT", "TGCA")
    tries = []
    for i, s in seqs.items():
        at = key(2, 0, i, 0, "start") % (len(s) - 5)
        x = s[at : at + 5]
        if "N" not in x:
            tries.append((key(2, 0, i, 0), min(x, x[::-1].translate(flip))))
    assert got[0] == sorted(tries)[:40]
    assert lsh.sampled(reads_of(spark), 5, 40, seed=3, keys=["id"]).collect() != lsh.sampled(reads_of(spark), 5, 40, seed=2, keys=["id"]).collect()


def test_samples_are_even_over_reads_and_places(spark):
    """Reads alike whatever their length; in a read each place but the last alike."""
    rows = [(i, ("ACGGTCA" if i % 2 else "ACGGTCATTGCAAGGCTCCT") + "") for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, seq string")
    got = lsh.sampled(df, 6, 1000, seed=1, keys=["id"], tries=1).collect()
    short = Counter(r.kmer for r in got)
    assert abs(sum(n for k, n in short.items() if k in ("ACGGTC", "GACCGT")) - 500 - 500 / 14) < 110
    many = lsh.sampled(df.where("id % 2 = 0"), 6, 2000, seed=1, keys=["id"]).groupBy("kmer").count().collect()
    assert len(many) == 14 and min(r["count"] for r in many) > 100


def test_few_reads_are_drawn_from_again(spark):
    df = spark.createDataFrame([("ACGTTGCATTGACCA",), ("ACGNNNNNNNNNNNN",)], "seq string")
    found = lsh.sample_kmers(df, 5, 4)
    assert len(found) == 40 and len(set(found)) > 5


def test_planes_have_one_form(monkeypatch):
    """Whatever singular vectors a library gives, of whatever phase and basis."""
    samples = [["ACGTA", "CCGTA", "ACGTT", "GCGTA", "ACTTA"], ["ACGTA"] * 5, ["ACGTA", "ACGTA", "TTTTT", "ACGTA", "TTTTT"]]
    first = [lsh.plane_through(s) for s in samples]
    real, rng = np.linalg.svd, np.random.default_rng(3)

    def turned(m):
        u, s, v = real(m)
        n = int((s <= 1e-10 * max(s[0], 1)).sum())
        z = rng.normal(size=(n, n)) + 1j * rng.normal(size=(n, n))
        v[len(v) - n :] = np.linalg.qr(z)[0] @ v[len(v) - n :]
        return u, s, v

    monkeypatch.setattr(np.linalg, "svd", turned)
    for s, (weights, c) in zip(samples, first):
        w, d = lsh.plane_through(s)
        assert np.allclose(w, weights) and np.isclose(d, c) and abs(d.imag) < 1e-12 and d.real > 0
        assert lsh.residuals(lsh.Planes(w[:, None], np.array([d])), s).max() < 1e-9
        assert np.isclose(np.linalg.norm([*w, d]), 1)


def test_reads_are_hashed_in_slices_of_bytes(monkeypatch, spark):
    p = planes()
    rng = np.random.default_rng(6)
    seqs = ["".join(rng.choice(list("ACGTN"), n, p=[0.24] * 4 + [0.04])) for n in (3000, 5, 0, 700, 6, 64, 1000)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id long, seq string")
    whole = {r.id: r.words for r in lsh.hash_reads(df, p, ["id"]).collect()}
    monkeypatch.setattr(lsh, "SLICE_BYTES", 100)
    offs = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    cuts = list(lsh._slices(offs))
    assert cuts[0] == (0, 1) and cuts[-1][1] == len(seqs) and all(hi - lo == 1 or offs[hi] - offs[lo] <= 100 for lo, hi in cuts)
    data = np.frombuffer("".join(seqs).encode(), np.uint8)
    for lo, hi in cuts:
        words, at = lsh.hash_pieces(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], p)
        assert [words[at[i] : at[i + 1]].tolist() for i in range(hi - lo)] == [whole[i] for i in range(lo, hi)]


def test_a_read_of_fifty_megabytes_is_hashed_in_pieces():
    data = np.frombuffer(b"ACGTTGCA" * (50 << 17), np.uint8)
    words, at = lsh.hash_pieces(data, np.array([0, len(data)]), planes())
    assert len(words) == at[1] == len(data) - planes().k + 1
    assert (words[8:] == words[:-8]).all()


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_sums_have_the_same_bits_over_partitions(spark, parts):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=3000) * 10.0 ** rng.integers(-6, 6, 3000)).tolist()
    df = spark.createDataFrame([(i, i % 3, v, [v, -v, 0.1]) for i, v in enumerate(x)], "i long, g long, x double, v array<double>").repartition(parts)
    whole = sum(round(v * 2**40) for v in x)
    assert df.agg(V.exact_sum("x")).first()[0] == pytest.approx(whole / 2**40, rel=1e-15)
    exact = {r.g: (r.s, r.v) for r in df.groupBy("g").agg(V.exact_sum("x").alias("s"), V.sum_in_order("i", "v", 3).alias("v")).collect()}
    one = {r.g: (r.s, r.v) for r in df.coalesce(1).groupBy("g").agg(V.exact_sum("x").alias("s"), V.sum_in_order("i", "v", 3).alias("v")).collect()}
    assert exact == one
    for g in range(3):
        total = [0.0] * 3
        for i, v in enumerate(x):
            if i % 3 == g:
                total = [a + b for a, b in zip(total, (v, -v, 0.1))]
        assert exact[g][1] == total


def test_means_of_few_components(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 3), (2, None, 1), (3, [5.0, 7.0], 2)], "k long, v array<double>, w long")
    for dim in (None, 2):
        assert {r.k: r.vec for r in V.mean_by(df, ["k"], "v", weight="w", dim=dim).collect()} == {1: pytest.approx([2.5, 5.0]), 3: pytest.approx([5.0, 7.0])}
        assert {r.k: r.vec for r in V.sum_by(df, ["k"], "v", dim=dim).collect()} == {1: pytest.approx([4.0, 8.0]), 3: pytest.approx([5.0, 7.0])}


def test_classes_and_their_links_stand_for_all_edges(spark, monkeypatch):
    """Each edge is of one class or of two linked ones, and the rows are few whatever the size of groups."""
    monkeypatch.setattr(E, "SHARES", 7)
    held = {i: {"hot", "copy"} for i in range(40)} | {i: {"hot", f"k{i}"} for i in range(40, 60)} | {70: {"pair"}, 71: {"pair"}, 72: {"alone"}}
    rows = [(r, k) for r, kmers in held.items() for k in kmers for _ in range(2)] + [(None, "hot"), (80, None)]
    members, links = E.kmer_classes(spark.createDataFrame(rows, "read long, kmer string").repartition(3))
    of = {r.read: (r.id, r.n) for r in members.collect()}
    assert of == {i: (0, 40) for i in range(40)} | {i: (i, 1) for i in range(40, 60)} | {70: (70, 2), 71: (70, 2), 72: (72, 1)}
    pairs = {(r.x.id, r.y.id) for r in links.collect()}
    linked = lambda a, b: of[a][0] == of[b][0] or (min(of[a][0], of[b][0]), max(of[a][0], of[b][0])) in pairs
    assert all(linked(a, b) == bool(held[a] & held[b]) for a in held for b in held if a < b)
    assert len(pairs) == 21 * 20 // 2


def test_plane_files_of_any_store(spark, tmp_path):
    p = lsh.fit_planes(["ACGTA", "CCGTA", "ACGTT", "GCGTA", "ACTTA"], 2)
    for url in (f"file://{tmp_path}/a.bin", f"{tmp_path}/b.bin"):
        p.save(url, spark)
        p.save(url, spark)
        assert lsh.Planes.load(url, spark).rows() == p.rows()
    assert lsh.Planes.load(str(tmp_path / "a.bin")).rows() == p.rows()
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith(".")) == ["a.bin", "b.bin"]
