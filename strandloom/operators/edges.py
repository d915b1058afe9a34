"""Read graphs: edges between reads that share a k-mer."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators.context import order_key
from strandloom.storage import stored


def all_pairs(ids) -> Column:
    """(src, dst) of each two elements in order; of a run of equal neighbours the first stands for all."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    once = F.transform(F.filter(F.transform(ids, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(ids, i - 1)).alias("p"))), lambda s: s["p"].isNull() | (s["p"] != s["x"])), lambda s: s["x"])
    pairs = F.transform(once, lambda a, i: F.transform(F.slice(once, i + 2, F.size(once)), lambda b: F.struct(a.cast("long").alias("src"), b.cast("long").alias("dst"))))
    return F.flatten(pairs)


def drawn_pairs(ids, max_degree: int, *draw, seed: int = 0) -> Column:
    """ceil(max_degree / 2 * n) random pairs with replacement, without those of an element with itself. Draws are keyed by ``draw``, so SQL and each retry make the same."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    n = F.size(ids)
    m = F.ceil(n * (max_degree / 2)).cast("int")
    pick = lambda i, side: F.element_at(ids, (F.pmod(order_key(i, F.lit(side), *draw, seed=seed), n) + 1).cast("int")).cast("long")
    pairs = F.transform(F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(pick(i, 0).alias("src"), pick(i, 1).alias("dst")))
    return F.filter(pairs, lambda p: p["src"] != p["dst"])


def generate_edges(ids, max_degree: int, *draw, seed: int = 0) -> Column:
    """All pairs of up to ``max_degree`` elements, random ones of more."""
    array = F.col(ids) if isinstance(ids, str) else ids
    return F.when(F.size(array) <= max_degree, all_pairs(array)).otherwise(drawn_pairs(array, max_degree, *draw, seed=seed))


#: Draws that a task makes at once.
DRAWS = 1 << 16


def _drawn(rows: DataFrame, keys: list[str], ids: Column, before: Column, after: Column, max_degree: int, first: int) -> DataFrame:
    """``keys``, src, dst: ceil(max_degree / 2 * n) pairs of each row's n ``ids``, without those of an id with itself.

    Draw t of a side is ``order_key`` of ``before``, t, side and ``after``: texts with their colons. MD5 sums are made in Arrow
    batches, as a row for each draw and Spark's ``conv`` take several times as long.
    """
    src = rows.select(*keys, ids.cast("array<long>").alias("_ids"), before.alias("_before"), after.alias("_after"))
    schema = src.select(*keys, F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst")).schema

    def run(batches):
        for batch in batches:
            lists, pre, post = (batch.column(len(keys) + i) for i in range(3))
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends, held, count = np.cumsum(sizes), [], 0

            def out():
                at = pa.array(np.concatenate([np.full(len(x), i) for i, x, _ in held]))
                pairs = [pa.array(np.concatenate([h[j] for h in held])) for j in (1, 2)]
                return pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(len(keys))), *pairs], names=[*keys, "src", "dst"])

            for i, (n, end, head, tail) in enumerate(zip(sizes.tolist(), ends.tolist(), pre.to_pylist(), post.to_pylist())):
                own, m, head, tail = flat[end - n : end], -(-n * max_degree // 2), head.encode(), tail.encode()
                for lo in range(0, m, DRAWS):
                    texts = (b"%b%d:%d%b" % (head, t, side, tail) for t in range(first + lo, first + min(m, lo + DRAWS)) for side in (0, 1))
                    sums = np.frombuffer(b"".join([md5(x, usedforsecurity=False).digest() for x in texts]), ">u8")[::2] >> np.uint64(4)
                    picked = own[(sums % np.uint64(n)).astype(np.int64)]
                    keep = picked[::2] != picked[1::2]
                    held.append((i, picked[::2][keep], picked[1::2][keep]))
                    count += len(held[-1][1])
                    if count >= DRAWS:
                        yield out()
                        held, count = [], 0
            if held:
                yield out()

    return src.mapInArrow(run, schema)


def read_edges(reads: DataFrame, max_degree: int, keys: list[str], array: str = "words", seed: int = 0) -> DataFrame:
    """``keys``, src, dst: ``generate_edges`` of each read, with draws keyed by ``keys``."""
    few = reads.where(F.size(array) <= max_degree).select(*keys, F.explode(all_pairs(array)).alias("e")).select(*keys, "e.src", "e.dst")
    after = F.concat_ws(":", F.lit(""), *(F.col(k).cast("string") for k in keys))
    return few.union(_drawn(reads.where(F.size(array) > max_degree), keys, F.col(array), F.lit(f"{seed}:0:"), after, max_degree, 1))


#: Reads of a block; pairs are made of two blocks at a time.
BLOCK = 1024


def _blocks(n) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


#: Shares that holders of a k-mer are dealt to while they are counted or numbered.
SHARES = 4096


def _shared(held: DataFrame, holder: str) -> DataFrame:
    """``held`` with ``n`` (holders of the k-mer), ``share`` of the holder and ``before``, the holders in shares before it.

    Counts go to holders by (kmer, share), so a frequent k-mer is no single key of a join; a window holds a row for each share.
    """
    dealt = held.withColumn("share", F.pmod(order_key(F.col(holder)), F.lit(SHARES)))
    every = Window.partitionBy("kmer")
    shares = dealt.groupBy("kmer", "share").agg(F.count("*").alias("own"))
    shares = shares.select("kmer", "share", F.sum("own").over(every).alias("n"), (F.sum("own").over(every.orderBy("share")) - F.col("own")).alias("before"))
    return dealt.join(shares, ["kmer", "share"])


def _linked(held: DataFrame) -> DataFrame:
    """Distinct (x, y) of the structs (id, n) in ``who`` that hold a k-mer in common, x before y, from distinct rows (kmer, who).

    Holders of a k-mer are dealt to blocks, and a task joins two blocks.
    """
    known = _shared(held, "who.id").where("n > 1").withColumn("part", F.pmod(F.xxhash64("who.id"), _blocks("n")).cast("int"))
    a = known.select("kmer", F.col("who").alias("x"), F.col("part").alias("i"), F.explode(F.sequence("part", _blocks("n") - 1)).alias("j"))
    b = known.select("kmer", F.col("who").alias("y"), F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"))
    pairs = a.join(b, ["kmer", "i", "j"]).where("i <> j OR x.id < y.id")
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def kmer_classes(held: DataFrame, read: str = "read", kmer: str = "kmer") -> tuple[DataFrame, DataFrame]:
    """(members: id, n, read; links: distinct pairs x, y of classes as structs (id, n), x before y) from rows (read, kmer).

    Reads of equal sets of k-mers are one class, named by its smallest read; classes are linked where they hold a k-mer in
    common. Together these are all edges, without a row for each: two reads share a k-mer if they are of one class or of linked ones.
    """
    rows = held.select(F.col(read).cast("long").alias("read"), F.col(kmer).alias("kmer")).where("read IS NOT NULL AND kmer IS NOT NULL")
    sets = stored(rows.groupBy("read").agg(F.sort_array(F.collect_set("kmer")).alias("kmers")).withColumn("key", F.sha2(F.to_json("kmers"), 256)))
    classes = stored(sets.groupBy("key").agg(F.struct(F.min("read").alias("id"), F.count("*").alias("n")).alias("who"), F.first("kmers").alias("kmers")))
    # By another form of the key than the classes are grouped by: then Spark can split the join where a class is large.
    members = sets.select(F.unhex("key").alias("id"), "read").join(classes.select(F.unhex("key").alias("id"), "who"), "id").select("who.id", "who.n", "read")
    return members, _linked(classes.select("who", F.explode("kmers").alias("kmer")))


def every_shared_kmer_edge(held: DataFrame, read: str = "read", kmer: str = "kmer") -> DataFrame:
    """Distinct (src < dst) of all reads that hold a k-mer in common, from rows (read, kmer), whatever the size of groups.

    Classes that share a k-mer are linked once, and reads of linked classes, and of each class, are paired in blocks of
    about ``BLOCK`` by ``BLOCK``: each pair is made once, and no row or task of that holds all reads of a k-mer or class. The
    result has as many rows as there are pairs; ``kmer_classes`` says the same in as many rows as there are reads and links.
    """
    members, links = kmer_classes(held, read, kmer)
    links = stored(links)
    few = links.where("x.n = 1 AND y.n = 1").select(F.col("x.id").alias("src"), F.col("y.id").alias("dst"))
    who = F.struct("id", "n")
    own = members.where("n > 1 AND id = read").select(who.alias("x"), who.alias("y"))
    much = links.where("x.n > 1 OR y.n > 1").union(own).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), _blocks("x.n").alias("p"), _blocks("y.n").alias("q"))
    much = much.select("a", "b", "q", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i")).select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j")).where("a <> b OR i <= j")
    members = members.select("id", "read", F.pmod(F.xxhash64("read"), _blocks("n")).cast("int").alias("part"))
    left = much.join(members.select(F.col("id").alias("a"), F.col("part").alias("i"), F.col("read").alias("src")), ["a", "i"])
    right = much.join(members.select(F.col("id").alias("b"), F.col("part").alias("j"), F.col("read").alias("dst")), ["b", "j"])
    many = left.join(right, ["a", "b", "i", "j"]).where("a <> b OR i <> j OR src < dst").select("src", "dst")
    return few.union(many).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def numbered(held: DataFrame) -> DataFrame:
    """kmer, read, n (holders of the k-mer), number (0 to n - 1) from distinct rows (kmer, read).

    Holders are numbered within shares, after those of the shares before: a task holds a share of a k-mer's holders.
    """
    place = F.row_number().over(Window.partitionBy("kmer", "share").orderBy("read"))
    return _shared(held, "read").select("kmer", "read", "n", (F.col("before") + place - 1).alias("number"))


def drawn_edges(holders: DataFrame, max_degree: int, seed: int = 0) -> DataFrame:
    """kmer, draw, src, dst: ceil(max_degree / 2 * n) pairs of each k-mer's holders with replacement, without those of a read with itself.

    From ``numbered`` rows. Each holder makes its share of the draws, so no row stands for all of a k-mer's; drawn numbers are joined back to reads.
    """
    first = lambda i: F.ceil(i * max_degree / 2)
    lo, hi = first(F.col("number")), first(F.col("number") + 1) - 1
    draws = holders.where(hi >= lo).select("kmer", "n", F.explode(F.sequence(lo, hi)).alias("draw"))
    pick = lambda side: F.pmod(order_key("kmer", "draw", F.lit(side), seed=seed), F.col("n"))
    draws = draws.select("kmer", "draw", pick(0).alias("u"), pick(1).alias("v")).where("u <> v")
    named = lambda number, read: holders.select("kmer", F.col("number").alias(number), F.col("read").alias(read))
    return draws.join(named("u", "src"), ["kmer", "u"]).join(named("v", "dst"), ["kmer", "v"]).select("kmer", "draw", "src", "dst")


#: Reads of a k-mer that one row lists, in the order of their numbers; draws of more are joined to them.
HELD = 1 << 16


def shared_kmer_edges(held: DataFrame, max_degree: int, seed: int = 0, read: str = "read", kmer: str = "kmer") -> DataFrame:
    """Distinct (src < dst) of reads that hold a k-mer in common, from rows (read, kmer).

    k-mers of up to ``max_degree`` reads give all pairs, more frequent ones ``drawn_edges``.
    """
    rows = stored(held.select(F.col(read).cast("long").alias("read"), F.col(kmer).alias("kmer")).where("read IS NOT NULL AND kmer IS NOT NULL").distinct())
    # There is at most one of these for each HELD rows.
    large = stored(rows.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") > HELD).select("kmer"))
    share = F.pmod(order_key("read"), F.lit(SHARES))
    groups = rows.join(F.broadcast(large), "kmer", "left_anti").groupBy("kmer").agg(F.sort_array(F.collect_list(F.struct(share.alias("share"), "read")))["read"].alias("ids")).withColumn("n", F.size("ids"))
    few = groups.where((F.col("n") > 1) & (F.col("n") <= max_degree)).select(F.explode(all_pairs(F.sort_array("ids"))).alias("e")).select("e.src", "e.dst")
    before = F.concat(F.lit(f"{seed}:0:"), "kmer", F.lit(":"))
    some = _drawn(groups.where((F.col("n") > max_degree) & (F.col("n") > 1)), [], F.col("ids"), before, F.lit(""), max_degree, 0)
    # Of very frequent k-mers no row holds all reads.
    known = stored(numbered(rows.join(F.broadcast(large), "kmer", "left_semi")))
    pairs = known.where(F.col("n") <= max_degree).groupBy("kmer").agg(F.sort_array(F.collect_list("read")).alias("ids")).select(F.explode(all_pairs("ids")).alias("e")).select("e.src", "e.dst")
    many = drawn_edges(known.where(F.col("n") > max_degree), max_degree, seed).select("src", "dst")
    every = few.union(some).union(pairs).union(many)
    return every.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
