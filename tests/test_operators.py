import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import context as C
from strandloom.operators import edges as E
from strandloom.operators import embed, lsh, train
from strandloom.plans.catalog import planes


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [7]), (3, []), (4, None), (5, [1, 1, 2])], "id long, words array<long>")


def window(w, i, hw):
    return w[max(0, i - hw) : i] + w[i + 1 : i + hw]


@pytest.mark.parametrize("hw", [1, 2, 5])
def test_contexts(words, hw):
    want = sorted((r.id, i, x, window(r.words, i, hw)) for r in words.collect() for i, x in enumerate(r.words or []))
    assert sorted((r.id, r.pos, r.center, r.context) for r in C.contexts(words, hw, ["id"]).collect()) == want
    rows = words.select("id", F.posexplode("words").alias("pos", "word"))
    assert sorted((r.id, r.pos, r.center, r.context) for r in C.contexts_windowed(rows, hw, ["id"]).collect()) == want


def test_word_counts(words):
    first = words.where("id = 1")
    pairs = {r.word: r.n for r in C.word_counts(first, 5, ["id"], skipgram=True).collect()}
    assert pairs == {i: 4 for i in range(1, 6)}
    # A read of one word trains nothing; with half-window 1 the first word has no context.
    assert {r.word: r.n for r in C.word_counts(words, 1, ["id"]).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1}
    dense = {r.word: r.n for r in C.dense_counts(C.word_counts(words, 1, ["id"]), 3).collect()}
    assert len(dense) == 8 and dense[7] == 0


def test_negatives_are_alike_likely_and_never_the_target(spark):
    df = spark.range(4000).select((F.col("id") % 5).alias("t"), C.negatives(F.col("id") % 5, 5, 3, F.col("id")).alias("n"), C.negatives_lcg(F.col("id") % 5, 5, 3, "id").alias("m"))
    rows = df.collect()
    assert all(r.t not in r.n and r.t not in r.m and all(0 <= x < 5 for x in r.n + r.m) for r in rows)
    counts = np.bincount([x for r in rows for x in r.n])
    assert counts.min() > 0.9 * counts.mean()
    with pytest.raises(ValueError):
        C.negatives("t", 1, 3)


def test_chunks_shuffles_and_ranges(spark, words):
    assert [r.c for r in words.where("id IN (1, 3)").orderBy("id").select(C.chunks("words", 2).alias("c")).collect()] == [[[1, 2], [3, 4], [5]], []]
    df = spark.range(100)
    for whole in (True, False):
        got = [r.id for r in C.shuffled(df, 1, whole).collect()]
        assert got != list(range(100)) and sorted(got) == list(range(100))
    ranks = [r.r for r in spark.range(16).select(C.word_rank("id", 16, 5).alias("r")).collect()]
    assert ranks == sorted(ranks) and max(ranks) == 4
    assert max(r.r for r in spark.range(16).select(C.word_rank("id", 16, 10).alias("r")).collect()) <= 9


@pytest.mark.parametrize("ids, cap, n", [([], 30, 0), ([2], 30, 0), ([2, 1], 30, 1), ([4, 20, 3, 10], 30, 6), (list(range(1, 18)), 300, 136), ([1, 1, 2], 30, 1)])
def test_all_edges(spark, ids, cap, n):
    df = spark.createDataFrame([(ids,)], "ids array<long>")
    assert len(df.select(E.generate_edges("ids", cap)).first()[0]) == n


def test_capped_edges(spark):
    df = spark.createDataFrame([(list(range(8)),)], "ids array<long>")
    got = df.select(E.generate_edges("ids", 6)).first()[0]
    assert 0 < len(got) <= 24 and all(e.src != e.dst for e in got)


def test_shared_kmer_edges(spark):
    rows = [(i, "hot") for i in range(300)] + [(1, "a"), (2, "a"), (3, "b"), (2, "b"), (2, "b"), (None, "b"), (9, None)]
    df = spark.createDataFrame(rows, "read long, kmer string")
    every = {(r.src, r.dst) for r in E.shared_kmer_edges(df.where("kmer <> 'hot'"), 10).collect()}
    assert every == {(1, 2), (2, 3)}
    capped = [(r.src, r.dst) for r in E.shared_kmer_edges(df, 6).collect()]
    # 900 pairs are drawn for the hot k-mer, with replacement: a few are of one read, or come twice.
    degree = np.bincount([x for e in capped for x in e])
    assert len(set(capped)) == len(capped) and all(a < b for a, b in capped) and 850 < len(capped) <= 902 and (degree[:300] > 0).mean() > 0.9


def reads(spark):
    return spark.createDataFrame([(1, "ACGTTGCANNACGTACG"), (2, "acgtgttt"), (3, ""), (4, None), (5, "GGGGGGGGGGGG"), (6, "ACG")], "id long, seq string")


@pytest.mark.parametrize("k, bits", [(5, 3), (7, 9), (15, 25)])
def test_lsh_forms_agree(spark, k, bits):
    p = planes(k, bits)
    rows = reads(spark).union(spark.createDataFrame([(7, "ACGTTGCATCGATCGATTGCAGT" * 3)], "id long, seq string"))
    for canonical in (True, False):
        got = {r.id: r.words for r in lsh.hash_reads(rows, p, ["id"], canonical=canonical).collect()}
        from strandloom.functions import seq as S

        for r in rows.select("id", S.kmers_forward(S.normalize_sequence("seq"), k, canonical).alias("k")).collect():
            assert got[r.id] == [p.hash(x) for x in r.k or []]
    kmers = rows.select("id", F.posexplode(S.kmers_forward(S.normalize_sequence("seq"), k)).alias("pos", "kmer"))
    joined = {(r.id, r.pos): r.word for r in lsh.hash_joined(kmers, p, ["id", "pos"]).collect()}
    assert joined == {(r.id, r.pos): p.hash(r.kmer) for r in kmers.collect()}
    if k * bits <= lsh.COLUMN_TERMS:
        for r in kmers.select("kmer", lsh.lsh_hash("kmer", p).alias("h"), lsh.lsh_hash("kmer", p, both=True).alias("b"), lsh.lsh_hash(S.reverse_complement("kmer"), p, both=True).alias("c")).collect():
            assert r.h == p.hash(r.kmer) and r.b == r.c == p.hash(r.kmer, both=True)


def test_planes(tmp_path):
    p = lsh.fit_planes(["ACGTA", "CCGTA", "ACGTT", "GCGTA", "ACTTA", "AGGTA"], 3, seed=1)
    assert lsh.Planes.from_bytes(p.to_bytes()).rows() == p.rows() and len(p.to_bytes()) == 12 + 24 * 3 + 16 * 5 * 3
    p.save(str(tmp_path / "rp.bin"))
    assert lsh.Planes.load(str(tmp_path / "rp.bin")).hash("ACGTA") == p.hash("ACGTA")
    for bad in (b"", b"x" * 40, p.to_bytes()[:-1]):
        with pytest.raises(ValueError):
            lsh.Planes.from_bytes(bad)
    same = lsh.fit_planes(["ACGTA", "CCGTA", "ACGTT", "GCGTA", "ACTTA", "AGGTA"], 1, indices=[[0, 1, 2, 3, 4]])
    weights, c = same.weights[:, 0], same.thresholds[0]
    m = np.array([[*lsh.encode(x), -1] for x in ["ACGTA", "CCGTA", "ACGTT", "GCGTA", "ACTTA"]])
    assert np.allclose(m @ np.conj([*weights, c]), 0)
    with pytest.raises(ValueError):
        lsh.Planes(np.zeros((3, 32)), np.zeros(32))


def test_fit_from_reads(spark):
    p = lsh.build_planes(reads(spark), 5, 4, seed=2)
    assert (p.k, p.bits) == (5, 4)
    with pytest.raises(ValueError, match="no read"):
        lsh.build_planes(spark.createDataFrame([("ACGNN",)], "seq string"), 5, 4)


def test_pooling_forms_agree(spark, words):
    model = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "word long, wi array<float>")
    want = {1: [3.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0], 5: [4 / 3, 1.0]}
    for f in (embed.mean_pool_joined, embed.mean_pool_broadcast, embed.mean_pool):
        got = {r.id: r.vec for r in f(words, model, ["id"], 2).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    rows = words.select("id", F.explode("words").alias("word"))
    assert [r.word for r in embed.missing_words(rows, model).collect()] == [7]
    with pytest.raises(Exception, match="no vector for word 7"):
        embed.lookup(rows, model).collect()


def test_kernel_updates_one_context():
    rng = np.random.default_rng(1)
    wi, wo = rng.normal(size=(6, 4)).astype(np.float32), rng.normal(size=(6, 4)).astype(np.float32)
    draws = iter([3, 5])
    k = train.Kernel(wi.copy(), wo.copy(), 2, lambda label: next(draws))
    loss = k.update(0, [1, 2, 2], 0.1)
    h = wi[[1, 2, 2]].mean(0)
    alpha = {w: 0.1 * ((w == 0) - train.sigmoid(float(wo[w] @ h))) for w in (0, 3, 5)}
    grad = sum(alpha[w] * wo[w] for w in alpha)
    assert np.allclose(k.wo, [wo[w] + alpha.get(w, 0) * h for w in range(6)], atol=1e-5)
    assert np.allclose(k.wi, [wi[w] + {1: 1, 2: 2}.get(w, 0) * grad for w in range(6)], atol=1e-5)
    assert loss == pytest.approx(-(train.log(train.sigmoid(float(wo[0] @ h))) + sum(train.log(1 - train.sigmoid(float(wo[w] @ h))) for w in (3, 5))) / 2)
    assert k.update(0, [], 0.1) == 0
    zero = train.Kernel(np.zeros((200, 10), np.float32), np.zeros((200, 10), np.float32), 5, lambda label: 7)
    assert zero.update(1, [2, 3], 0.1) == pytest.approx(0.831777, abs=1e-3)


def test_sql_step_is_the_kernel_for_one_context(spark):
    rng = np.random.default_rng(3)
    wi, wo = rng.normal(size=(6, 4)).astype(np.float32), rng.normal(size=(6, 4)).astype(np.float32)
    model = spark.createDataFrame([(i, wi[i].tolist(), wo[i].tolist()) for i in range(6)], "word long, wi array<float>, wo array<float>")
    rows = spark.createDataFrame([(1, 0, [1, 2, 2], [3, 5])], "id long, center long, context array<long>, negatives array<long>")
    new, losses = train.sql_step(rows, model, 0.1, 2, ["id"])
    draws = iter([3, 5])
    k = train.Kernel(wi.copy(), wo.copy(), 2, lambda label: next(draws))
    loss = k.update(0, [1, 2, 2], 0.1)
    got = {r.word: r for r in new.collect()}
    assert losses.first().loss == pytest.approx(loss, abs=1e-5)
    assert all(np.allclose(got[w].wi, k.wi[w], atol=1e-5) and np.allclose(got[w].wo, k.wo[w], atol=1e-5) for w in range(6))


def corpus(spark):
    rng = np.random.default_rng(4)
    rows = [(i, ((rng.integers(4) * 4 + rng.integers(0, 4, 20)) % 16).tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "id long, words array<long>").repartition(2)


@pytest.mark.parametrize("skipgram", [False, True])
def test_training_lowers_the_loss(spark, skipgram, monkeypatch):
    o = train.Options(4, dim=8, lr=0.1, half_window=3, neg=3, epochs=3, skipgram=skipgram, seed=5)
    model, losses = train.train(corpus(spark), o)
    assert losses[-1] < losses[0] and model.count() == 16
    assert model.agg(F.sum("wc")).first()[0] == C.word_counts(corpus(spark), 3, ["id"], skipgram=skipgram).agg(F.sum("n")).first()[0]


@pytest.mark.parametrize("mode, batch, skipgram", [("local", 1, False), ("local", 16, False), ("local", 16, True), ("joined", 1, False)])
def test_the_loss_falls_at_the_default_rate(spark, mode, batch, skipgram):
    o = train.Options(4, dim=8, lr=0.3, half_window=2, neg=3, epochs=2, seed=5, mode=mode, batch=batch, partitions=2, steps=3, skipgram=skipgram)
    model, losses = train.train(corpus(spark).limit(20) if mode == "joined" else corpus(spark), o)
    rows = model.collect()
    assert losses[1] < losses[0] and len(rows) == 16
    assert max(abs(x) for r in rows for x in (*r.wi, *r.wo)) < 10


def test_a_model_that_does_not_fit_is_refused(spark, monkeypatch):
    monkeypatch.setattr(train, "BROADCAST_FLOATS", 10)
    monkeypatch.setattr(embed, "BROADCAST_FLOATS", 10)
    with pytest.raises(ValueError, match="joined"):
        train.train(corpus(spark), train.Options(4, dim=8, epochs=1))
    model = spark.createDataFrame([(i, [1.0] * 8) for i in range(4)], "word long, wi array<float>")
    with pytest.raises(ValueError, match="joined"):
        embed.mean_pool_broadcast(corpus(spark), model, ["id"], 8)


@pytest.mark.parametrize("skipgram", [False, True])
def test_one_partition_is_the_sequential_order(spark, skipgram):
    """A brute-force epoch: plain loops over reads, words, labels and components."""
    rows = [[1, 2, 3, 1], [3, 3, 2], [5], [], [2, 5, 1, 1, 2]]
    df = spark.createDataFrame([(r,) for r in rows], "words array<long>").coalesce(1)
    o = train.Options(3, dim=3, lr=0.3, half_window=2, neg=2, epochs=1, seed=4, partitions=1, skipgram=skipgram)
    model, losses = train.train(df, o)
    got = {r.word: r for r in model.collect()}
    known = [1, 2, 3, 5]
    start = {r.word: r for r in train.initial(spark.createDataFrame([(w,) for w in known], "word long"), o).collect()}
    wi, wo = ([list(map(float, getattr(start[w], side))) for w in known] for side in ("wi", "wo"))
    order = df.repartition(1).toPandas()["words"]
    draws = iter(np.random.default_rng([4, 0, 0]).integers(3, size=4096).tolist())
    total = []
    for read in order:
        read, own = [known.index(w) for w in read], []
        for i, label in enumerate(read):
            around = [read[j] for j in range(max(0, i - 2), min(len(read), i + 2)) if j != i]
            for context in [[w] for w in around] if skipgram else [around]:
                if not context:
                    own.append(0.0)
                    continue
                hidden = [sum(wi[w][d] for w in context) / len(context) for d in range(3)]
                grad, loss = [0.0] * 3, 0.0
                targets = [label]
                for _ in range(2):
                    r = next(draws)
                    targets.append(r + (r >= label))
                for n, t in enumerate(targets):
                    score = train.sigmoid(sum(wo[t][d] * hidden[d] for d in range(3)))
                    a = 0.3 * ((n == 0) - score)
                    loss -= train.log(score if n == 0 else 1 - score)
                    for d in range(3):
                        grad[d] += a * wo[t][d]
                        wo[t][d] += a * hidden[d]
                for w in context:
                    for d in range(3):
                        wi[w][d] += grad[d]
                own.append(loss / 2)
        total.append(sum(own) / len(own) if own else 0.0)
    for i, w in enumerate(known):
        assert np.allclose(got[w].wi, wi[i], atol=1e-4) and np.allclose(got[w].wo, wo[i], atol=1e-4)
    assert losses == pytest.approx([sum(total) / len(total)], abs=1e-4)


def test_partitions_draw_their_own_negatives(spark):
    """Two partitions with the same reads end with different vectors."""
    o = train.Options(4, dim=4, half_window=2, neg=2, epochs=1, seed=1)
    words = np.arange(16)
    wi = np.random.default_rng(0).normal(size=(16, 4)).astype(np.float32)
    shared = spark.sparkContext.broadcast((words, wi, wi.copy()))
    df = spark.createDataFrame([(list(range(16)),)] * 2, "words array<long>").repartition(2)
    out = df.mapInArrow(train._epoch(shared, o, 0), "word long, di array<float>, do array<float>, loss double, reads long, part int").where("word IS NULL").collect()
    assert [r.reads for r in out] == [1, 1] and out[0].loss != out[1].loss


def test_uniform_vectors_stay_uniform(spark):
    o = train.Options(4, dim=5, lr=0.1, half_window=2, neg=2, epochs=1, init="uniform", dense=True, partitions=1)
    model = train.train(corpus(spark), o)[0].collect()
    assert len(model) == 16 and all(max(r.wi) - min(r.wi) < 1e-6 and max(r.wo) - min(r.wo) < 1e-6 for r in model)


def test_options_are_checked():
    for bad in ({"neg": 0}, {"bits": 32}, {"init": "x"}, {"epochs": 0}, {"mode": "x"}, {"batch": 0}):
        with pytest.raises(ValueError):
            train.Options(**{"bits": 4} | bad)


def test_sql_step_looks_words_up_in_place(spark):
    """Without a shuffle of rows, and the same as by joins, words without vectors included."""
    rows = spark.range(200).select(
        F.col("id"), (F.col("id") % 5).alias("center"), F.expr("transform(sequence(1, int(id % 3) + 1), i -> (id * 7 + i) % 6)").alias("context"), F.array((F.col("id") + 1) % 5, (F.col("id") * 3) % 7).alias("negatives")
    )
    vec = lambda shift: F.array(*(((F.col("id") * 31 + d * 17 + shift) % 101) / 100.0 for d in range(3)))
    model = spark.range(5).select(F.col("id").alias("word"), vec(0).alias("wi"), vec(50).alias("wo"))
    for mean in (False, True):
        for exact in (False, True):
            slow, slow_loss = train.sql_step(rows, model, 0.1, 2, ["id"], exact_sigmoid=exact, mean=mean)
            fast, fast_loss = train.sql_step(rows, model, 0.1, 2, ["id"], exact_sigmoid=exact, mean=mean, width=3)
            assert "Exchange hashpartitioning" not in fast_loss._jdf.queryExecution().executedPlan().toString()
            a, b = ({r.id: r.loss for r in x.collect()} for x in (slow_loss, fast_loss))
            assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)
            a, b = ({r.word: [*r.wi, *r.wo] for r in x.collect()} for x in (slow, fast))
            assert a.keys() == b.keys() and all(np.allclose(a[w], b[w], atol=1e-9) for w in a)
    with pytest.raises(Exception, match="more than 2 words"):
        train.sql_step(rows, model, 0.1, 2, ["id"], width=2)[1].collect()
