import random

import numpy as np
import pytest

from strandloom.llm import graph, nearjoin


def brute(docs, k, percent):
    sets = {}
    for i, text in docs:
        w = [x.decode().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in (text or "").encode().split()]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, groups=12, copies=8, length=80, edits=3):
    rnd = random.Random(seed)
    word = lambda: f"v{rnd.randrange(3000)}"
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(5, length))]
        for _ in range(rnd.randint(1, copies)):
            own = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                own[rnd.randrange(len(own))] = word()
            docs.append((len(docs), " ".join(own)))
    docs += [(len(docs), ""), (len(docs) + 1, None), (len(docs) + 2, "A b"), (len(docs) + 3, "a B"), (len(docs) + 4, "a")]
    return docs


@pytest.mark.parametrize("seed, k", [(1, 4), (2, 5), (3, 2)])
def test_like_brute_force(docs_of, seed, k):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nearjoin.near_duplicates(docs_of(docs), k).collect()}
    assert got == brute(docs, k, 80)


def test_large_nodes_branch_and_blocks_meet(docs_of, monkeypatch):
    monkeypatch.setattr(nearjoin, "NODE", 6)
    monkeypatch.setattr(nearjoin, "BLOCK", 7)
    monkeypatch.setattr(nearjoin, "BROADCAST_ROWS", 0)
    docs = corpus(5, groups=3, copies=60, length=60, edits=2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nearjoin.near_duplicates(docs_of(docs), 4).collect()}
    assert got == brute(docs, 4, 80)


def test_one_document_of_each_group_stays(docs_of):
    docs = corpus(7)
    rows = nearjoin.near_duplicates(docs_of(docs), 4).collect()
    kept = [r.component_id for r in rows if r.kept]
    assert sorted(kept) == sorted({r.component_id for r in rows})


def test_awkward_rows(docs_of, awkward):
    rows = nearjoin.near_duplicates(docs_of(awkward, extra=True), 4).collect()
    assert len(rows) == len(awkward)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == 0 and by[1].kept and by[2].component_id == 2
    assert by[5].component_id == 4 and not by[5].kept
    assert by[None].component_id is None and by[None].kept
    assert by[3].n_shingles == 2 and by[8].n_shingles == 1
    assert nearjoin.near_duplicates(docs_of([]), 4).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: root(i) for i in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_of_a_regular_build_are_told_apart(docs_of):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = nearjoin.near_duplicates(docs_of([(1, f"{a} x y z"), (2, f"{b} x y z"), (3, f"{a} x  Y z")]), 4).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 2, 3: 1}


def test_equal_hashes_do_not_link(docs_of, monkeypatch):
    """Even if all shingles and words had one hash, links are those of the words."""
    monkeypatch.setattr(nearjoin, "shingles", lambda w, k: (np.repeat(np.uint64(7), len(w.off) - 1), np.arange(len(w.off) - 1)))
    docs = [(i, " ".join(f"{'same' if i < 3 else i}{j}" for j in range(30 + i % 2))) for i in range(8)]
    rows = nearjoin.near_duplicates(docs_of(docs), 4).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: c for i, (_, c) in brute(docs, 4, 80).items()}


@pytest.mark.parametrize("block", [7, 40])
def test_no_pair_of_different_components_is_left_out(docs_of, monkeypatch, block):
    """Candidate groups far larger than a block, of many components, large and small."""
    monkeypatch.setattr(nearjoin, "BLOCK", block)
    monkeypatch.setattr(nearjoin, "ROUNDS", 1)
    monkeypatch.setattr(nearjoin, "SEEM", 0.3)
    rnd = random.Random(11)
    base = [f"v{i}" for i in range(60)]
    docs = []
    for family in range(6):
        own = base[:30] + [f"f{family}_{i}" for i in range(30)]
        for _ in range(rnd.choice([2, 9, 30])):
            w = list(own)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(60)] = f"e{rnd.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    got = {r.doc_id: r.component_id for r in nearjoin.near_duplicates(docs_of(docs), 4).collect()}
    assert got == {i: c for i, (_, c) in brute(docs, 4, 80).items()}


def test_pairs_at_the_threshold_are_found(docs_of, monkeypatch):
    """Pairs of 80 to 82 %, all in nodes well over NODE, as they share half their words with hundreds of others."""
    monkeypatch.setattr(nearjoin, "NODE", 20)
    rnd = random.Random(12)
    common = [f"c{i}" for i in range(90)]
    docs = []
    for p in range(150):
        # Five of 180 words differ, four of them in 4 shingles each and one in 3: 158 of 196 are shared.
        w = common + [f"p{p}_{i}" for i in range(90)]
        other = list(w)
        for i in [2, *rnd.sample(range(12, 177, 9), 4)]:
            other[i] = f"o{p}_{i}"
        docs += [(2 * p, " ".join(w)), (2 * p + 1, " ".join(other))]
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in docs}
    share = [100 * len(sets[2 * p] & sets[2 * p + 1]) / len(sets[2 * p] | sets[2 * p + 1]) for p in range(150)]
    assert min(share) >= 80 and max(share) <= 82
    got = {r.doc_id: r.component_id for r in nearjoin.near_duplicates(docs_of(docs), 4).collect()}
    want = {i: c for i, (_, c) in brute(docs, 4, 80).items()}
    assert got == want
    assert sum(i != c for i, c in want.items()) > 100


def test_texts_of_one_id_are_one_document(docs_of):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = nearjoin.near_duplicates(docs_of([(5, a), (5, b), (3, b), (9, a)]), 4).collect()
    assert {r.component_id for r in rows} == {3}
