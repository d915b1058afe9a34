import math
import random

import numpy as np
import pytest

from strandloom.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=50):
    """Results by sorting all products."""
    fit = [(i, [math.floor(256 * float(np.float32(x))) for x in e], y) for i, e, y in rows if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, v, y in fit:
        if a % every:
            continue
        score = lambda w: sum(p * q for p, q in zip(v, w))  # noqa: E731,B023
        own = sorted((-score(w), i) for i, w, z in fit if z == y and i != a)[:5]
        others = sorted((-score(w), i) for i, w, z in fit if z != y)
        for p, positive in own:
            fits = [(n, i) for n, i in others if 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, positive, r + 1, i, -p, -n) for r, (n, i) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, extra=False, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for c in ("id", "v", "key", "rank", "score", "found", "chunk", "n"):
            df = df.withColumn(c, F.lit("x"))
    return sorted(tuple(r) for r in hardneg.mine(df, **more).collect())


def vectors(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) * np.linspace(2, 0.1, dim)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    return [(i, base[i].astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("dim", [24, 40, 5])
def test_against_plain_sorting(spark, dim):
    data = vectors(400, dim, dim)
    assert mined(spark, data, every=10, extra=True) == plain(data, 10)


@pytest.mark.parametrize("block, rows", [(16, 4096), (8, 50), (5, 7), (3, 64)])
def test_chunk_searches_in_blocks_and_parts(monkeypatch, block, rows):
    """What tasks run, here with small blocks of components and parts of rows (workers would not see these settings)."""
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "ROWS", rows)
    data = vectors(300, 22, 7) + [(1000 + i, [0.25] * 22, i % 4) for i in range(30)]
    v = np.array([[math.floor(256 * float(np.float32(x))) for x in e] for _, e, _ in data])
    ids, labels = (np.array([d[i] for d in data]) for i in (0, 2))
    turn = np.linalg.eigh((v.T @ v).astype(float))[1][:, ::-1]
    own = np.flatnonzero(ids % 10 == 0)
    anchors = {"id": ids[own], "label": labels[own], "v": v[own], "key": own}
    key, found, score = hardneg._positives(hardneg.Chunk(ids, labels, v, turn, 6), anchors)
    scores = np.full((len(own), 5), 0)
    for n, a in enumerate(own):
        want = sorted((-int(v[a] @ v[b]), int(ids[b])) for b in range(len(ids)) if labels[b] == labels[a] and b != a)[:5]
        assert sorted(zip((-score[key == a]).tolist(), found[key == a].tolist())) == want
        scores[n] = [-w for w, _ in want]
    anchors |= {"whole": scores, "scores": scores.astype(float)}
    key, n, found, score = hardneg._negatives(hardneg.Chunk(ids, labels, v, turn, 3), anchors)
    for i, a in enumerate(own):
        others = sorted((-int(v[a] @ v[b]), int(ids[b])) for b in range(len(ids)) if labels[b] != labels[a])
        for j, p in enumerate(scores[i].tolist()):
            want = [(s, b) for s, b in others if 50 * p <= 100 * -s <= 95 * p][:3]
            at = (key == a) & (n == j)
            assert sorted(zip((-score[at]).tolist(), found[at].tolist())) == want


def test_nulls_ties_copies_and_short_vectors(spark):
    data = vectors(120, 6, 3, labels=2)
    same = data[7][1]
    data += [(1000 + i, same, i % 3) for i in range(60)] + [(2000, same, 1), (2000, same, 1), (2000, same, 0)]
    data += [(3000, None, 1), (3001, [], 1), (3050, [0.5], 0), (3002, [0.5, None], 1), (3003, [float("nan")], 1), (3004, [float("inf")], 1), (3005, same, None), (None, same, 1), (3100, [-x for x in same], 5)]
    random.Random(1).shuffle(data)
    assert mined(spark, data) == plain(data)


def test_one_label_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CHUNK_BYTES", 2000)
    data = [(i, e, 0 if i % 3 else y) for i, e, y in vectors(300, 12, 9)]
    assert mined(spark, data, every=20) == plain(data, 20)


def test_empty_tables_and_one_row(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_components_out_of_bounds_end_the_job(spark):
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, [1e9], 1), (1, [1.0], 1)])


def test_bounds_discard_before_all_components_are_summed(monkeypatch):
    """The point of the rotation: where few components hold most of the length, few exact products are left."""
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(2000, 64)) * 256 * np.exp(-np.arange(64) / 6)).astype(np.int64)
    turn = np.linalg.eigh((v.T @ v).astype(float))[1][:, ::-1]
    a, x = hardneg.Turned(v[:50], turn), hardneg.Turned(v, turn)
    seen, real = [], hardneg.kth
    monkeypatch.setattr(hardneg, "kth", lambda s, k: seen.append(1) or real(s, k))
    i, j = hardneg.survivors(a, x, np.full(50, -np.inf), 5)
    assert len(seen) < 4 and len(i) <= 50 * 5 * hardneg.ENOUGH
    exact = v[:50] @ v.T
    kept = set(zip(i.tolist(), j.tolist()))
    assert all((r, c) in kept for r in range(50) for c in np.argsort(-exact[r], kind="stable")[:5].tolist())
