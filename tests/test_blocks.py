from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import blocks as B
from strandloom.operators import context as C
from strandloom.operators import train
from strandloom.storage import stored

READS = [(1, [1, 2, 3, 1, 2, 0, 0, 4]), (2, []), (3, None), (4, [5]), (5, [2, 2, 2, 2, 1]), (6, list(range(6)) * 9), (7, [3, 4])]


def rows_of(spark, parts=2):
    return spark.createDataFrame(READS, "read long, words array<long>").repartition(parts, "read")


def model(dim=3, n=6):
    rng = np.random.default_rng(1)
    return rng.normal(size=(n, dim)), rng.normal(size=(n, dim))


def frame(spark, wi, wo):
    return spark.createDataFrame([(i, wi[i].tolist(), wo[i].tolist()) for i in range(len(wi))], "word long, wi array<double>, wo array<double>")


def _made():
    """Sent to workers by value, as they cannot import tests."""

    def draw(read, pos, part, center):
        r = (read[:, None] * 7 + pos[:, None] * 3 + part[:, None] * 11 + np.arange(2) * 5) % 5
        return r + (r >= center[:, None])

    return draw


draw = _made()


def plain(wi, wo, lr, hw, skipgram, mean):
    """One step by loops over positions, from one model."""
    d_in, d_out, losses = defaultdict(list), defaultdict(list), []
    for read, words in READS:
        words, own = words or [], []
        for i, label in enumerate(words):
            around = [j for j in range(max(0, i - hw), min(len(words), i + hw)) if j != i]
            updates = [(p, [j]) for p, j in enumerate(around)] if skipgram else [(0, around)]
            for part, context in updates:
                if not context:
                    own.append(0.0)
                    continue
                h = np.mean([wi[words[j]] for j in context], axis=0)
                targets = [label, *draw(*(np.array([x]) for x in (read, i, part, label)))[0].tolist()]
                score = [train.sigmoid(float(wo[t] @ h)) for t in targets]
                alpha = [lr * ((n == 0) - s) for n, s in enumerate(score)]
                grad = sum(a * wo[t] for a, t in zip(alpha, targets))
                for a, t in zip(alpha, targets):
                    d_out[t].append(a * h)
                for j in context:
                    d_in[words[j]].append(grad)
                own.append(-(train.log(score[0]) + sum(train.log(1 - s) for s in score[1:])) / 2)
        losses.append(sum(own) / len(own) if own else 0.0)
    merged = np.mean if mean else np.sum
    return [[m[w] + (merged(d[w], axis=0) if w in d else 0) for w in range(len(m))] for m, d in ((wi, d_in), (wo, d_out))], sum(losses) / len(losses)


@pytest.mark.parametrize("positions", [8192, 7, 1])
@pytest.mark.parametrize("skipgram, mean, hw", [(False, False, 3), (True, False, 2), (False, True, 1), (True, True, 3)])
def test_step_equals_plain_loops(spark, monkeypatch, positions, skipgram, mean, hw):
    """Whatever the blocks: whole, pieces of reads, or single positions."""
    monkeypatch.setattr(B, "POSITIONS", positions)
    wi, wo = model()
    packed = stored(B.pack(rows_of(spark), hw))
    params = B.Params.create(frame(spark, wi, wo), 3, 2)
    new, losses = params.step(packed, B.Step(0.2, 2, hw, draw, skipgram, mean=mean))
    (want_i, want_o), want_loss = plain(wi, wo, 0.2, hw, skipgram, mean)
    got = {r.word: r for r in new.table().collect()}
    assert sorted(got) == list(range(6))
    assert all(np.allclose(got[w].wi, want_i[w]) and np.allclose(got[w].wo, want_o[w]) for w in got)
    assert B.mean_loss(losses).first() == (pytest.approx(want_loss), len(READS))
    params.drop()
    assert all(np.allclose(r.wi, want_i[r.word]) for r in new.table().collect())
    new.drop()


@pytest.mark.parametrize("skipgram", [False, True])
def test_kernel_takes_centers_in_parts(spark, monkeypatch, skipgram):
    row = B.pack(rows_of(spark, 1), 3).first().asDict()
    block, (wi, wo) = B._Block(row, 3, skipgram), model()
    s = B.Step(0.2, 2, 3, draw, skipgram)
    whole = B.kernel(block, np.arange(6), wi, wo, s)
    monkeypatch.setattr(B, "AT_ONCE", 5)
    assert all(np.allclose(a, b) for a, b in zip(whole, B.kernel(block, np.arange(6), wi, wo, s)))


def test_pieces_of_long_reads_see_what_stands_around(spark, monkeypatch):
    monkeypatch.setattr(B, "POSITIONS", 4)
    rows = B.pack(rows_of(spark, 1), 2).collect()
    centers = defaultdict(list)
    for r in rows:
        at = 0
        for read, start, left, size, length, whole in zip(r.read, r.start, r["left"], r.size, r.length, r.whole):
            piece = r.words[at : at + length]
            at += length
            own = dict(READS)[read] or []
            assert piece == own[max(0, start - 2) : min(len(own), start + size + 1)] and left == min(2, start)
            assert whole == (len(own) <= 4)
            centers[read] += piece[left : left + size]
        assert at == len(r.words) and sum(r.size) <= 4
    assert centers == {read: own or [] for read, own in READS} and len({r.block for r in rows}) == len(rows)


def test_a_very_long_read(spark):
    """Fifty million letters' worth of pieces keep their bound; here 300,000 words."""
    read = spark.range(1).select(F.lit(9).alias("read"), F.transform(F.sequence(F.lit(0), F.lit(299_999)), lambda i: i % 6).alias("words"))
    packed = stored(B.pack(read, 3))
    assert packed.count() == -(-300_000 // B.POSITIONS) and packed.agg(F.max(F.size("words"))).first()[0] <= B.POSITIONS + 5
    wi, wo = model()
    new, losses = B.Params.create(frame(spark, wi, wo), 3, 2).step(packed, B.Step(0.1, 2, 3, draw, mean=True))
    assert new.table().count() == 6 and B.mean_loss(losses).first().reads == 1


def test_no_exchange_on_the_side_of_the_model(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wi, wo = model()
        params = B.Params.create(frame(spark, wi, wo), 3, 3)
        packed = stored(B.pack(rows_of(spark), 2))
        moves = spark.createDataFrame([(1, [0] * 3, [0] * 3, 1, 1)], "word long, di array<long>, do array<long>, ni long, no long")
        for df in (params.gathered(B.asked(packed, 2, False, draw)), params.moved(moves, False)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            # One exchange, by the requests' or the moves' word; the scan of the model stands under the join without one.
            assert plan.count("Exchange ") == 1 and "Bucketed: true" in plan and "SelectedBucketsCount: 3 out of 3" in plan
            df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_word_without_vector_ends_the_job(spark):
    wi, wo = model(n=4)
    params = B.Params.create(frame(spark, wi, wo), 3, 2)
    with pytest.raises(Exception, match="no vector for word"):
        params.gathered(B.asked(stored(B.pack(rows_of(spark), 2)), 2, False, None)).collect()


def test_renamed_words(spark):
    packed = stored(B.pack(rows_of(spark), 2))
    names = spark.createDataFrame([(w, 50 - w) for w in range(6)], "word long, rank long")
    got = {r.block: r for r in B.renamed(packed, names).collect()}
    for r in packed.collect():
        assert got[r.block].words == [50 - w for w in r.words] and got[r.block].read == r.read


@pytest.mark.parametrize("mean", [False, True])
def test_sums_of_moves_have_the_same_bits_over_partitions(spark, mean):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(4)), rng.integers(-(2**40), 2**40, 3).tolist(), rng.integers(-(2**40), 2**40, 3).tolist(), 2, 3) for _ in range(500)]
    got = []
    for parts in (1, 3, 8):
        params = B.Params.create(frame(spark, *model()), 3, parts)
        moves = spark.createDataFrame(rows, "word long, di array<long>, do array<long>, ni long, no long").repartition(parts)
        got.append(sorted((r.word, r.wi, r.wo) for r in params.moved(moves, mean).collect()))
    assert got[0] == got[1] == got[2]
    wi, _ = model()
    total = [sum(r[1][d] for r in rows if r[0] == 0) / 2**32 for d in range(3)]
    times = sum(r[3] for r in rows if r[0] == 0) if mean else 1
    assert np.allclose(got[0][0][1], wi[0] + np.array(total) / times)


def test_moves_that_are_not_finite_end_the_job():
    for x in (np.nan, np.inf, 2.0**31):
        with pytest.raises(ValueError, match="too large"):
            B._lists(np.array([[x]]))


def test_joined_training_is_the_same_on_each_run(spark):
    """The same steps, draws and sums, to the last bit."""
    rng = np.random.default_rng(4)
    rows = [(i, ((rng.integers(4) * 4 + rng.integers(0, 4, 20)) % 16).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, words array<long>").coalesce(1)
    o = train.Options(4, dim=4, lr=0.3, half_window=2, neg=2, epochs=2, seed=5, mode="joined", steps=3)
    a, b = (train.train(df, o) for _ in range(2))
    assert a[1] == b[1] and a[1][1] < a[1][0]
    x, y = ({r.word: r for r in m.collect()} for m, _ in (a, b))
    assert all(x[w].wi == y[w].wi and x[w].wo == y[w].wo for w in x) and len(x) == 16


def test_keyed_order(spark):
    rows = spark.range(250).repartition(5)
    batches = defaultdict(dict)
    for r in C.shuffled_batches(rows, "id", 100, seed=1, epoch=2).collect():
        batches[r.batch][r.place] = r.id
    assert [sorted(b) for _, b in sorted(batches.items())] == [list(range(100)), list(range(100)), list(range(50))]
    assert all(sorted(b.values()) == list(range(i * 100, i * 100 + len(b))) for i, b in batches.items())
    order = lambda epoch: [r.id for r in C.keyed_order(spark.range(250).coalesce(1), "id", 1, epoch, 100).collect()]
    assert order(2) == [b[i] for _, b in sorted(batches.items()) for i in sorted(b)] == order(2) != order(3)


def test_shuffled_training_is_the_same_on_each_run(spark):
    """The order comes from keys, so losses are those of a run whose tasks were tried again."""
    rows = spark.createDataFrame([([i % 7, (i * 3) % 7, (i + 2) % 7, i % 5],) for i in range(40)], "words array<long>").coalesce(1)
    run = lambda **k: train.train(rows, train.Options(3, dim=3, lr=0.2, half_window=2, neg=2, epochs=2, seed=1, partitions=2, **k))[1]
    assert run(shuffle=10) == run(shuffle=10) != run(shuffle=0)
