import random

import numpy as np
import pytest

from strandloom.llm import common, ordinal

SF = "/root/testdata/sf0.1"


def test_regression_finds_ordered_thresholds_and_weights():
    rng = np.random.default_rng(1)
    n, weights, cuts = 6000, np.array([2.0, -1.0, 0.5]), np.array([0.5, 2.0])
    on = rng.random((n, 3)) < 0.5
    latent = on @ weights + rng.logistic(size=n)
    grade = (latent[:, None] > cuts).sum(1)
    rows, cols = np.nonzero(on)
    w, t = ordinal.regress(rows, cols, 3, grade, 3, l2=0.0)
    assert np.allclose(w, weights, atol=0.25) and np.allclose(t, cuts, atol=0.25) and t[0] < t[1]


def test_gradient_is_that_of_the_likelihood():
    """The fit is a stationary point: moving any parameter lowers the likelihood."""
    rng = np.random.default_rng(2)
    on = rng.random((500, 2)) < 0.4
    grade = np.minimum(2, on.sum(1) + (rng.random(500) < 0.3))
    rows, cols = np.nonzero(on)
    w, t = ordinal.regress(rows, cols, 2, grade, 3, l2=0.0, steps=3000)

    def loglik(w, t):
        s = on @ w
        f = lambda e: 1 / (1 + np.exp(-np.clip(e - s, -40, 40)))
        edge = [np.zeros(500), f(t[0]), f(t[1]), np.ones(500)]
        return np.log([edge[g + 1][i] - edge[g][i] for i, g in enumerate(grade)]).sum()

    best = loglik(w, t)
    for i in range(2):
        for d in (-0.05, 0.05):
            assert loglik(w + d * np.eye(2)[i], t) < best and loglik(w, t + d * np.eye(2)[i]) < best


def test_held_out_accuracy(spark):
    docs, labels = common.documents(spark, SF), common.documents(spark, SF, "labels")
    train = labels.where("doc_id % 4 <> 0")
    scored = ordinal.score(docs, ordinal.fit(docs, train)).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    flagged = [r.p_toxic >= ordinal.REJECT_AT for r in scored]
    right = sum(f and r.toxic for f, r in zip(flagged, scored))
    assert right / max(1, sum(flagged)) > 0.9 and right / sum(r.toxic for r in scored) > 0.7


def test_severity_is_the_expected_grade(docs_of):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4
        words = [f"c{rnd.randrange(200)}" for _ in range(30)] + [f"bad{j}" for j in range(3 * bad)]
        rows.append((i, " ".join(words)))
        labels.append((i, bad))
    docs = docs_of(rows)
    known = docs.sparkSession.createDataFrame(labels, "doc_id long, grade int")
    model = ordinal.fit(docs, known, label="grade", graded=True)
    got = {r.doc_id: r for r in ordinal.score(docs, model).collect()}
    assert sum(got[i].grade == g for i, g in labels) > 380
    means = [np.mean([got[i].severity for i, g in labels if g == k]) for k in range(4)]
    assert means == sorted(means)


@pytest.mark.parametrize("labels", [[], [(4, None)], [(4, 0), (5, 0)], [(None, 1)]])
def test_without_two_classes_nothing_is_rejected(docs_of, awkward, labels):
    docs = docs_of(awkward, extra=True)
    model = ordinal.fit(docs, docs.sparkSession.createDataFrame(labels, "doc_id long, toxic int"))
    rows = ordinal.score(docs, model, keep=("doc_id", "text", "grade")).collect()
    assert len(rows) == len(awkward) and all(r.grade == 0 and r.p_toxic < 1e-9 for r in rows)
    assert ordinal.score(docs_of([]), model).count() == 0


def test_features_and_scores_like_a_plain_reading(docs_of):
    """Texts are scored as by plain loops over words, beginnings, weights and thresholds."""
    import re

    rnd = random.Random(5)
    words = ["Alpha", "beta", "gammas", "GAMMATA", "ü1", "über", "x", "betamax", "delta9"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(12))) + rnd.choice([".", "!", ""]) for _ in range(60)] + [None, ""]

    def plain(text):
        out = set()
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower()):
            out.add((0, w))
            out |= {(i + 1, w[:p]) for i, p in enumerate(ordinal.PREFIXES) if len(w) > p}
        return out

    # The name of a feature is that of a text with its word alone; its last two bits are its kind.
    name = {}
    for w in {w for t in texts for k, w in plain(t) if k == 0}:
        for h in ordinal.features(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0].tolist():
            kind = h & 3
            name[kind, w[: ordinal.PREFIXES[kind - 1]] if kind else w] = h
    assert len(set(name.values())) == len(name) > 15
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        h, r = ordinal.features(data, np.array([0, len(data)]))
        assert sorted(h.tolist()) == sorted(name[f] for f in plain(t)) and not r.any()
    weight = {f: rnd.uniform(-1, 1) for f in rnd.sample(sorted(name), 15)}
    name = {f: name[f] for f in weight}
    keys = np.array(sorted(name.values()), np.uint64)
    by = {n: f for f, n in name.items()}
    model = ordinal.Model(keys, np.array([weight[by[int(k)]] for k in keys]), np.array([-0.2, 0.7]))
    got = {r.doc_id: r for r in ordinal.score(docs_of(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        s = sum(weight[f] for f in plain(t) if f in name)
        p = [1 / (1 + np.exp(c - s)) for c in (-0.2, 0.7)]
        assert got[i].severity == pytest.approx(sum(p)) and got[i].p_toxic == pytest.approx(p[0]) and got[i].grade == sum(x >= 0.5 for x in p)
