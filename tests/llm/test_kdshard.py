import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from strandloom.llm import kdshard


def shards(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.shard].append(r)
    return out


def test_sizes_are_near_equal_and_slots_gapless(docs_of):
    rnd = random.Random(1)
    rows = [(i, "é" * rnd.choice([1, 10, 100, 1000]), "hot" if i % 3 else f"s{i % 7}", rnd.choice(["en", "de"])) for i in range(3000)]
    got = kdshard.shard(docs_of(rows), 24).collect()
    by = shards(got)
    assert sorted(by) == list(range(24)) and len(got) == 3000
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) < 6 * 2008
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    text = {r[0]: r[1].encode() for r in rows}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)


def test_cuts_follow_the_widest_dimension(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("size"), (F.col("id") % 2).alias("a"), (F.col("id") * 0).alias("b"))
    got = kdshard.assign(rows, 2, ["b", "a"]).collect()
    assert len({(r.a, r.shard) for r in got}) == 2
    weighted = kdshard.assign(rows.withColumn("size", F.when(F.col("doc_id") < 100, 9).otherwise(1)), 2, ["doc_id"], bins=7).collect()
    assert {r.doc_id for r in weighted if r.shard == 0} == set(range(100))


def test_each_node_is_cut_like_a_plain_tree(spark, docs_of):
    """Each node, from its rows alone: along its widest dimension, where its left side's weight comes near its share."""
    rnd = random.Random(3)
    rows = spark.createDataFrame([(i, rnd.choice([9, 20, 300, 2000]), float(rnd.randrange(50)), rnd.choice([None, 1.0, 7.0])) for i in range(4000)], "doc_id long, size long, a double, b double")
    got = kdshard.keyed(kdshard.assign(rows, 11, ["a", "b", "doc_id"], bins=16), ["a", "b", "doc_id"]).collect()

    def check(node, first, k):
        if k == 1:
            assert {r.shard for r in node} <= {first}
            return
        width = [max(r._k[i] for r in node) - min(r._k[i] for r in node) for i in range(3)]
        d = width.index(max(width))
        left, right = [r for r in node if r.shard < first + k // 2], [r for r in node if r.shard >= first + k // 2]
        assert max(r._k[d] for r in left) < min(r._k[d] for r in right)
        off = sum(r.size for r in left) - sum(r.size for r in node) * (k // 2) / k
        assert abs(off) <= max(r.size for r in node)
        check(left, first, k // 2)
        check(right, first + k // 2, k - k // 2)

    check(got, 0, 11)


def test_many_buckets_and_target_bytes(docs_of, monkeypatch):
    monkeypatch.setattr(kdshard, "BUCKET_ROWS", 50)
    docs = docs_of([(i, "x" * 92) for i in range(1000)])
    by = shards(kdshard.shard(docs, target_bytes=10_000).collect())
    assert sorted(by) == list(range(10)) and all(abs(len(v) - 100) <= 2 for v in by.values())
    numbered = kdshard.numbered(docs.withColumn("shard", F.lit(0)), ["doc_id"], 1000, bucket_rows=50).collect()
    assert sorted(r.slot for r in numbered) == list(range(1000))


def test_native_plan(docs_of):
    plan = kdshard.shard(docs_of([(1, "a")]), 3)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_awkward_rows(docs_of, awkward):
    got = kdshard.shard(docs_of(awkward, extra=True), 24).collect()
    assert len(got) == len(awkward) and all(0 <= r.shard < 24 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].size == 8 and by[1].text_crc32 == 0 and by[2].size == 8
    for v in shards(got).values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    assert kdshard.shard(docs_of([]), 24).count() == 0
