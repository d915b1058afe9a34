import corpus_pipeline
from pyspark.sql import functions as F
from test_nearjoin import brute as near_brute

from strandloom.llm import boilerplate, bpe, common, decontaminate

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = common.documents(spark, SF)
    columns = docs.dtypes
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.stored(stage(spark, docs, SF))
        assert docs.dtypes == columns
        kept[name] = (before, docs)
    # Clean documents stay, though there are few labels to learn from here; most toxic ones go.
    labels = common.documents(spark, SF, "labels")
    before, after = kept["toxicity"]
    gone = before.join(labels, "doc_id").join(after, "doc_id", "left_anti").groupBy("toxic").count()
    gone, all_of = ({r.toxic: r["count"] for r in x.collect()} for x in (gone, labels.groupBy("toxic").count()))
    assert gone.get(0, 0) <= 0.02 * all_of[0] and gone[1] >= 0.6 * all_of[1]
    assert after.count() < before.count()
    # Lines.
    before, after = kept["line_dedup"]
    want = {r.doc_id: r.text for r in boilerplate.drop_boilerplate(before).collect()}
    got = after.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    # Near-duplicates: one document of each group.
    before, after = kept["near_dedup"]
    sample = [(r.doc_id, r.text) for r in before.where("doc_id < 250").collect()]
    want = {i for i, (_, c) in near_brute(sample, 5, 80).items() if c == i}
    few = corpus_pipeline.near_dedup(spark, before.where("doc_id < 250"), SF)
    assert {r.doc_id for r in few.collect()} == want
    # Decontamination.
    before, after = kept["decontamination"]
    found = decontaminate.find(before, common.documents(spark, SF, "benchmark")).where(F.size("hit_spans") > 0)
    gone = before.join(after, "doc_id", "left_anti")
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in gone.collect()} != set()
    # Tokens give the texts back.
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    back = bpe.decode(tokens, *bpe.public(), ids="tokens").join(docs, "doc_id").collect()
    assert len(back) == docs.count() and all(bytes(r.bytes).decode() == r.text for r in back)


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "tokens"] and 500 < rows.count() < 1000


def test_awkward_rows(docs_of, awkward, spark):
    docs = docs_of(awkward, extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, SF))
        assert out.dtypes == docs.dtypes
        docs = out
    left = sorted(r.doc_id or 0 for r in docs.collect())
    assert left == [0, 1, 2, 3, 4, 7, 8]
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0


def test_near_dedup_keeps_each_text_of_a_shared_id(docs_of, spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    left = corpus_pipeline.near_dedup(spark, docs_of([(5, a), (5, b), (3, b), (5, b), (None, a)]), SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, a), (3, b), (5, a)]
