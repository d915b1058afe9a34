import re

import numpy as np
import pytest
import xxhash

from strandloom.llm import simhash


def fingerprint(text, k=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius=3):
    """Smallest id reachable, row by row."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, fp, least.get(root(i))) for i, (doc, fp) in enumerate(prints)]


def rows(df):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [4096, 5])
def test_against_plain_reading(docs_of, awkward, monkeypatch, size):
    monkeypatch.setattr(simhash, "TREE_SIZE", size)
    rng = np.random.default_rng(5)
    docs = [(100 + i, " ".join(rng.choice(["Tick", "tock", "é", "x", "Ünder", "42"], 400))) for i in range(40)]
    docs += [(200 + i, docs[i][1].replace("42", "43", 1)) for i in range(20)] + [(300 + i, docs[i][1]) for i in range(5)]
    docs += [*awkward, (400, "one"), (401, "ONE"), (402, "one two"), (403, "one two three"), (None, "one")]
    got = rows(simhash.near_duplicates(docs_of(docs, extra=True)))
    want = classes([(d[0], fingerprint(d[1])) for d in docs])
    assert got == sorted(want, key=str)
    assert len({c for d, _, c in got if d is not None and d >= 200 and c < 200}) > 0


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []


@pytest.mark.parametrize("radius", [1, 3, 6])
@pytest.mark.parametrize("size", [7, 4096])
def test_links_join_what_brute_force_joins(spark, monkeypatch, radius, size):
    """Chains, a dense ball of prints that share blocks (more than one tree), and prints far from all."""
    monkeypatch.setattr(simhash, "TREE_SIZE", size)
    monkeypatch.setattr(simhash, "AT_ONCE", 50)
    rng = np.random.default_rng(radius)
    far = rng.integers(0, 2**64, 60, dtype=np.uint64)
    ball = [int(far[0]) ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(1, 64, 9)]
    chain, x = [], int(far[1])
    for i in range(30):
        x ^= sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        chain.append(x)
    prints = sorted({*map(int, far), *ball, *chain, 0, 2**64 - 1})
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long").repartition(3)
    a, b = (np.array(v, np.int64) for v in zip(*((prints.index(r.a % 2**64), prints.index(r.b % 2**64)) for r in simhash.links(df, radius).collect())))
    got = simhash.spanning(len(prints), a, b)
    want = classes(list(enumerate(prints)), radius)
    assert got.tolist() == [c for _, _, c in want]


def test_tree_edges_are_distances_and_searches_are_whole():
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64) & np.uint64(0xFF00FF))
    root = np.zeros(len(fp), np.int64)
    forest = simhash.Forest.grown(fp, root)
    assert len(forest.children) == len(fp) - 1 == len(set(forest.children.tolist()))
    for edge, child in zip(forest.edges.tolist(), forest.children.tolist()):
        assert edge % 65 == (int(fp[edge // 65]) ^ int(fp[child])).bit_count()
    assert len(set(forest.edges.tolist())) == len(forest.edges)
    q, node = forest.within(fp, root, 2)
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 2}
    assert set(zip(q.tolist(), node.tolist())) == want and len(q) == len(want)


def test_long_text_counts_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    data = np.frombuffer((text + "a b").encode(), np.uint8)
    offs = np.array([0, len(text), len(text), len(data)])
    whole = simhash.counted(data, offs)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.counted(data, offs).tolist() == whole.tolist() == [fingerprint(text), 0, fingerprint("a b")]
