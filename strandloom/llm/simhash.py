"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees of shards.

Fingerprints that differ in at most ``radius`` of 64 bits agree on one of ``radius + 1`` blocks of bits, so each is filed
under its blocks, and a shard (block and value) holds all that can be linked there. A shard's fingerprints become a
BK-tree: each child hangs on its parent by their integer Hamming distance, and a search that stands at distance d follows
only the edges d - radius to d + radius. Shards beyond ``TREE_SIZE`` are several trees, each sent to every other part of
its shard (in a shuffle: fingerprints of all documents don't go through the driver). A task turns what it finds into a
spanning forest before it leaves, so that a group of near copies gives links in proportion to its size and loses none.

Nulls: a null or empty text, or one without words, has the fingerprint zero and is linked like any other. A null id takes
part, but names no component (null where no row of the component has an id). Rows that share an id are rows of their own.
Repeated rows and ties share a fingerprint. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a tree at most (about: shards are dealt out by hash), and those that a task links at once.
TREE_SIZE, AT_ONCE = 4096, 1 << 16
#: Shingles whose bits are counted at once; places of a search at once.
CHUNK, PLACES = 1 << 16, 1 << 22


def counted(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints (uint64) of texts given as bytes and offsets."""
    words = common.Words(data, offs, common.NOT_SPACE, lower=True)
    joined, at = words.joined()
    view, digest = memoryview(np.ascontiguousarray(joined)), xxhash.xxh64_intdigest
    n = np.diff(words.off)
    shingles = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), shingles)
    before = np.cumsum(shingles) - shingles
    ones = np.zeros((len(n), 64), np.int64)
    for lo in range(0, len(row), CHUNK):
        own = row[lo : lo + CHUNK]
        first = words.off[own] + np.arange(lo, lo + len(own)) - before[own]
        spans = zip(at[first].tolist(), (at[np.minimum(first + k, words.off[own + 1])] - 1).tolist())
        h = np.fromiter((digest(view[a:z], seed) for a, z in spans), "<u8", len(own))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        start = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[start]] += np.add.reduceat(bits, start, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each row."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in common.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counted(data, offs, k, seed).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(common.tidy(run), "doc_id long, fp long")


class Forest:
    """BK-trees of several groups of distinct fingerprints: node i holds ``fp[i]``; the first of a group is its root.

    ``edges`` are parent * 65 + distance, ascending, and ``children`` the nodes they lead to.
    """

    def __init__(self, fp: np.ndarray, edges: np.ndarray, children: np.ndarray):
        self.fp, self.edges, self.children = fp, edges, children

    @classmethod
    def grown(cls, fp: np.ndarray, root: np.ndarray) -> Forest:
        """``root``: of each fingerprint, the first of its group. All walk down at once; the first to come to a free edge stays there."""
        at, left = root.copy(), np.flatnonzero(root != np.arange(len(fp)))
        edges, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left):
            edge = at[left] * 65 + np.bitwise_count(fp[left] ^ fp[at[left]])
            taken, first, which = np.unique(edge, return_index=True, return_inverse=True)
            new = left[first]
            edges.append(taken)
            children.append(new)
            at[left] = new[which]
            left = left[at[left] != left]
        edges, children = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edges)
        return cls(fp, edges[order], children[order])

    def within(self, query: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) within ``radius`` of each other; each search starts at its ``root``."""
        q, node, found = np.arange(len(query)), root, []
        while len(q):
            d = np.bitwise_count(query[q] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            found.append((q[near], node[near]))
            lo = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), "right") - lo
            place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            q, node = np.repeat(q, n), self.children[place]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest of those it is linked with through the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _links(fp: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    label = spanning(len(fp), a, b)
    own = np.flatnonzero(label != np.arange(len(fp)))
    return fp[own].view(np.int64), fp[label[own]].view(np.int64)


_TREE = "shard long, part int, parts int, fps array<long>, edges array<long>, children array<long>, a long, b long"


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array(arrays, pa.list_(pa.int64()))


def _firsts(shard: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Where groups of rows begin."""
    return np.concatenate([[0], np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1])


def _grow(radius: int):
    """Links within each (shard, part), and the trees of shards of several parts."""

    def linked(shard, part, parts, fp):
        first = _firsts(shard, part)
        size = np.diff(np.append(first, len(fp)))
        root = np.repeat(first, size)
        forest = Forest.grown(fp, root)
        step, found = max(1, PLACES // int(size.max())), []
        for lo in range(0, len(fp), step):
            q, node = forest.within(fp[lo : lo + step], root[lo : lo + step], radius)
            found.append((q + lo, node))
        a, b = _links(fp, found)
        n = len(a)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.list_(pa.int64())) for _ in range(3)), pa.array(a), pa.array(b)], schema=SCHEMA)
        for i in np.flatnonzero(parts[first] > 1).tolist():
            lo, hi = first[i], first[i] + size[i]
            x, z = np.searchsorted(forest.edges, [lo * 65, hi * 65])
            row = [pa.array(shard[lo : lo + 1]), pa.array(part[lo : lo + 1], pa.int32()), pa.array(parts[lo : lo + 1], pa.int32()), *map(_lists, ([fp[lo:hi].view(np.int64)], [forest.edges[x:z] - lo * 65], [forest.children[x:z] - lo]))]
            yield pa.RecordBatch.from_arrays([*row, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], schema=SCHEMA)

    def run(batches):
        held = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) >= AT_ONCE:
                # Up to where the last group, which may go on, begins.
                if cut := int(_firsts(*held[:2])[-1]):
                    yield from linked(*(x[:cut] for x in held[:3]), held[3][:cut].view(np.uint64))
                    held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from linked(*held[:3], held[3].view(np.uint64))

    return run


SCHEMA = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("fps", pa.list_(pa.int64())), ("edges", pa.list_(pa.int64())), ("children", pa.list_(pa.int64())), ("a", pa.int64()), ("b", pa.int64())])


def _across(radius: int):
    """Links between a tree and the fingerprints of another part of its shard."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                fps, edges, children, query = (batch.column(c)[i].values.to_numpy() for c in ("fps", "edges", "children", "query"))
                forest, query, found = Forest(fps.view(np.uint64), edges, children), query.view(np.uint64), []
                step = max(1, PLACES // len(fps))
                for lo in range(0, len(query), step):
                    part = query[lo : lo + step]
                    q, node = forest.within(part, np.zeros(len(part), np.int64), radius)
                    found.append((q + lo + len(fps), node))
                a, b = _links(np.concatenate([forest.fp, query]), found)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, fp: str = "fp") -> DataFrame:
    """(a, b) of distinct fingerprints, enough to join all that a chain of links of at most ``radius`` bits joins."""
    if not 1 <= radius <= 31:
        raise ValueError("radius is 1 to 31")
    width = 64 // (radius + 1)
    values = [F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << (width if i < radius else 64 - radius * width)) - 1).cast("long")) for i in range(radius + 1)]
    members = prints.select(F.col(fp).alias("fp"), F.explode(F.array(*(v * (radius + 1) + i for i, v in enumerate(values)))).alias("shard"))
    counts = members.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / TREE_SIZE).cast("int")
    dealt = members.join(counts, "shard").select("shard", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), parts.alias("parts"), "fp")
    grown = common.stored(dealt.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(common.tidy(_grow(radius)), _TREE))
    trees = grown.where("shard IS NOT NULL")
    sent = trees.where("part < parts - 1").select("shard", F.col("part").alias("i"), F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("j"), "fps", "edges", "children")
    asked = trees.where("part > 0").select("shard", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("i"), F.col("part").alias("j"), F.col("fps").alias("query"))
    across = sent.join(asked, ["shard", "i", "j"]).select("fps", "edges", "children", "query").mapInArrow(common.tidy(_across(radius)), "a long, b long")
    return grown.where("shard IS NULL").select("a", "b").union(across)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable through links) of each row."""
    prints = common.stored(fingerprints(docs, k, text=text, doc_id=doc_id))
    # Copies are one node from here on.
    own = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("m")))
    labels = components(links(own, radius)).select(F.col("id").alias("fp"), "component")
    named = own.join(labels, "fp", "left").select("fp", "m", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("m").alias("component_id"))
    return prints.join(named.join(least, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op11(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
