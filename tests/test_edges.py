import math
from collections import Counter
from itertools import combinations

import pytest

from strandloom.operators import edges as E
from strandloom.plans import catalog

SF = "/root/testdata/sf0.001"


def by_doc(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, Counter())[r.src, r.dst] += 1
    return out


def once(words):
    return [w for i, w in enumerate(words) if i == 0 or words[i - 1] != w]


def test_edges_of_whole_reads(spark):
    words = {r.doc_id: r.words for r in catalog.words(spark, SF).collect()}
    assert max(map(len, words.values())) > 30
    want = {d: Counter(combinations(once(w), 2)) for d, w in words.items()}
    assert by_doc(catalog.QUERIES["generate_edges_all"](spark, SF)) == {d: c for d, c in want.items() if c}


def test_capped_edges_keep_their_bounds(spark):
    words = {r.doc_id: r.words for r in catalog.words(spark, SF).collect()}
    got = by_doc(catalog.QUERIES["generate_edges_capped"](spark, SF))
    few = {d: w for d, w in words.items() if len(w) <= 30}
    assert few and len(few) < len(words)
    for d, w in words.items():
        edges = got.get(d, Counter())
        if d in few:
            assert edges == Counter(combinations(once(w), 2))
        else:
            assert 0 < edges.total() <= math.ceil(15 * len(w)) and all(a != b and {a, b} <= set(w) for a, b in edges)
    assert len({tuple(got[d]) for d in words if d not in few}) > 1


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_every_edge_of_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    held = {i: {"hot", "copy"} for i in range(40)} | {i: {"hot", f"k{i}"} for i in range(40, 60)} | {i: {"pair", "other"} for i in (70, 71)} | {72: {"pair"}, 73: {"alone"}, 74: {"k41", "pair"}}
    rows = [(r, k) for r, kmers in held.items() for k in kmers for _ in range(2)] + [(None, "hot"), (80, None)]
    got = [(r.src, r.dst) for r in E.every_shared_kmer_edge(spark.createDataFrame(rows, "read long, kmer string").repartition(3)).collect()]
    assert sorted(got) == [(a, b) for a, b in combinations(sorted(held), 2) if held[a] & held[b]]


def test_uncapped_query_never_draws(spark, monkeypatch):
    """Neither the capped operator nor a limit on the size of groups."""
    kmers = spark.range(300).selectExpr("id AS doc_id", "0 AS pos", "'ACGTACGTACGT' AS kmer")
    monkeypatch.setattr(catalog, "kmers", lambda *_: kmers)
    monkeypatch.setattr(E, "shared_kmer_edges", lambda *_: pytest.fail("capped"))
    monkeypatch.setattr(E, "BLOCK", 50, raising=False)
    assert catalog.QUERIES["shared_kmer_edges"](spark, SF).count() == 300 * 299 // 2
