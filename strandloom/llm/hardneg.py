"""Hard negatives by exact inner products, with an orthogonal PCA rotation to discard early.

Vectors become integers, floor(256 * x). An eigenbasis of their second moments turns them so that the leading components
hold most of each product. Partial products grow component block by component block; what is left of a product is at most
the product of the residual norms, so with slack for rounding each pair has an upper and a lower bound. The k-th best lower
bound, known before any product is whole, is the bar: pairs whose upper bound is under it go at once. Survivors are
decided by exact integer products.

Rows are dealt to chunks of bounded size, and the anchors (a stated fraction of the rows) are sent to each chunk in the
shuffle, in two passes: positives, then negatives in the windows that positives set. A chunk gives the best of each
anchor, and windows keep the best of all chunks. Copies of a vector count as one while products are taken.

Nulls: a row without id, label or vector, or with a null or non-finite component takes no part. Shorter vectors count as
followed by zeros; an empty one is all zeros. Rows with an anchor's own id are none of its other rows. Repeated rows stay
rows of their own, also as anchors. Extra columns are not read. An empty table, or one without anchors, gives an empty
result. A component over 2**26 in size ends the job with an error, as products then may leave 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Negatives have 50 to 95 percent of the positive's score.
LOW, HIGH = 50, 95
#: Bytes of integer vectors that a task holds; anchors and rows whose products are taken at once; components of a block.
CHUNK_BYTES, ANCHORS, ROWS, BLOCK = 64 << 20, 256, 4096, 16
#: Of the product of two norms: far over what sums of doubles can be off by.
SLACK = 1e-9
#: Survivors for each anchor and wanted row, from which on the exact products are taken.
ENOUGH = 4
LIMIT = 1 << 26


def integers(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, v (whole numbers) of the rows that take part."""
    x = F.col("e")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(ok, F.lit(False)))
    small = F.forall(x, lambda c: F.abs(c) <= LIMIT / SCALE)
    v = F.transform(x, lambda c: F.floor(c * SCALE).cast("int"))
    return own.select("id", "label", F.when(small, v).otherwise(F.raise_error(F.lit("a component is too large for products in 64 bits"))).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column, with zeros after the end of short ones."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(n), dim), flat.dtype)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal columns, by falling share of the squared length of all rows. Brings dim * dim sums to the driver."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = matrix(batch.column(0), dim).astype(float)
            total += m.T @ m
        i = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total.ravel())], names=["i", "x"])

    sums = rows.select("v").mapInArrow(moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros(dim * dim)
    total[sums.column("i").to_numpy()] = sums.column("x").to_numpy()
    turn = np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1]
    if dim and np.abs(turn.T @ turn - np.eye(dim)).max() > 1e-10:
        raise ValueError("the rotation is not orthogonal")
    return np.ascontiguousarray(turn)


class Turned:
    """Integer vectors with their rotated components and the norms of what follows each block."""

    def __init__(self, v: np.ndarray, turn: np.ndarray):
        self.v, self.r = v.astype(np.int64), v @ turn
        rest = np.cumsum((self.r**2)[:, ::-1], axis=1)[:, ::-1]
        self.norm = np.sqrt(rest[:, 0]) if v.shape[1] else np.zeros(len(v))
        self.rest = np.sqrt(np.concatenate([rest[:, BLOCK::BLOCK], np.zeros((len(v), 1))], axis=1))


def kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; minus infinity where there are fewer."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def survivors(a: Turned, x: Turned, bar: np.ndarray, k: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) that can be among an anchor's ``k`` best, or the ``k`` best of one of its windows ``low`` to ``high``.

    ``bar`` (a number for each anchor, or each window) is raised as bounds allow.
    """
    total, wanted = np.zeros((len(a.v), len(x.v))), k * (1 if low is None else low.shape[1])
    off = SLACK * np.outer(a.norm, x.norm) + SLACK
    keep = np.ones_like(total, bool)
    for i, at in enumerate(range(0, a.v.shape[1], BLOCK)):
        total += a.r[:, at : at + BLOCK] @ x.r[:, at : at + BLOCK].T
        rest = np.outer(a.rest[:, i], x.rest[:, i]) + off
        upper, lower = total + rest, total - rest
        if low is None:
            np.maximum(bar, kth(lower, k), out=bar)
            keep = upper >= bar[:, None]
        else:
            keep = np.zeros_like(keep)
            for j in range(low.shape[1]):
                lo, hi = low[:, j, None], high[:, j, None]
                if (high[:, j] < low[:, j]).all():
                    continue
                inside = (lower >= lo) & (upper <= hi)
                bar[:, j] = np.maximum(bar[:, j], kth(np.where(inside, lower, -np.inf), k))
                keep |= (upper >= np.maximum(bar[:, j, None], lo)) & (lower <= hi)
        if np.count_nonzero(keep) <= ENOUGH * wanted * len(a.v):
            break
    return np.nonzero(keep)


def products(a: Turned, x: Turned, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    step = max(1, (1 << 22) // max(1, a.v.shape[1]))
    for lo in range(0, len(i), step):
        out[lo : lo + step] = np.einsum("ij,ij->i", a.v[i[lo : lo + step]], x.v[j[lo : lo + step]])
    return out


class Chunk:
    """Rows of a chunk by label; of copies (one label, one vector) the ``copies`` with the smallest ids stay."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, turn: np.ndarray, copies: int):
        same = np.unique(v, axis=0, return_inverse=True)[1].ravel() if v.shape[1] else np.zeros(len(v), int)
        order = np.lexsort((ids, same, labels))
        new = np.flatnonzero(np.diff(same[order], prepend=-1) | np.diff(labels[order], prepend=labels[order[:1]] - 1))
        turns = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
        order = order[turns < copies]
        self.ids, self.labels, self.v, self.turn = ids[order], labels[order], v[order], turn

    def parts(self, lo: int, hi: int):
        """(first row, rotated rows) of bounded parts of the rows lo to hi."""
        for at in range(lo, hi, ROWS):
            yield at, Turned(self.v[at : min(hi, at + ROWS)], self.turn)

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))


def best(keys: list[np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each key: by score, then by smaller id."""
    order = np.lexsort((ids, -scores, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    first = np.flatnonzero(new)
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]


def _positives(chunk: Chunk, anchors: dict) -> list[np.ndarray]:
    out = []
    for label in np.unique(anchors["label"]).tolist():
        own = np.flatnonzero(anchors["label"] == label)
        a, bar, found = Turned(anchors["v"][own], chunk.turn), np.full(len(own), -np.inf), []
        for at, x in chunk.parts(*chunk.of_label(label)):
            # One more than wanted, as an anchor's own row may be among them.
            i, j = survivors(a, x, bar, POSITIVES + 1)
            score, ids = products(a, x, i, j), chunk.ids[at + j]
            other = ids != anchors["id"][own][i]
            found.append((i[other], ids[other], score[other]))
        if found:
            i, ids, score = (np.concatenate(f) for f in zip(*found))
            top = best([i], ids, score, POSITIVES)
            out.append((anchors["key"][own][i[top]], ids[top], score[top]))
    return [np.concatenate(x) for x in zip(*out)] if out else []


def _negatives(chunk: Chunk, anchors: dict) -> list[np.ndarray]:
    out = []
    for label in np.unique(anchors["label"]).tolist():
        own = np.flatnonzero(anchors["label"] == label)
        a, positive = Turned(anchors["v"][own], chunk.turn), anchors["scores"][own].astype(float)
        # Whole scores n with LOW * p <= 100 * n <= HIGH * p, a little wider; absent positives (NaN) have no window.
        low, high = np.nan_to_num(LOW * positive / 100 - 0.5, nan=1.0), np.nan_to_num(HIGH * positive / 100 + 0.5, nan=0.0)
        bar, found = np.full(low.shape, -np.inf), []
        before, after = chunk.of_label(label)
        for lo, hi in ((0, before), (after, len(chunk.ids))):
            for at, x in chunk.parts(lo, hi):
                i, j = survivors(a, x, bar, NEGATIVES, low, high)
                score = products(a, x, i, j)
                for n in range(positive.shape[1]):
                    p = anchors["whole"][own][i, n]
                    fits = ~np.isnan(positive[i, n]) & (LOW * p <= 100 * score) & (100 * score <= HIGH * p)
                    found.append((i[fits], np.full(fits.sum(), n), chunk.ids[at + j[fits]], score[fits]))
        if found:
            i, n, ids, score = (np.concatenate(f) for f in zip(*found))
            top = best([i, n], ids, score, NEGATIVES)
            out.append((anchors["key"][own][i[top]], n[top], ids[top], score[top]))
    return [np.concatenate(x) for x in zip(*out)] if out else []


def _searched(shared, dim: int, find, copies: int, names: list[str]):
    """Within a chunk, whose rows come before the anchors (those have a key)."""

    def run(batches):
        turn, rows, chunk = shared.value, [], None

        def block(batch):
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            own = {c: get(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "key")} | {"v": matrix(get("v"), dim)}
            if find is _negatives:
                scores = get("scores")
                whole = matrix(scores, POSITIVES)
                own["whole"] = whole
                own["scores"] = np.where(np.arange(POSITIVES) < scores.value_lengths().to_numpy(zero_copy_only=False)[:, None], whole, np.nan)
            return own

        for batch in batches:
            n = batch.column(batch.schema.get_field_index("key")).null_count
            if n:
                rows.append([batch.column(batch.schema.get_field_index(c)).slice(0, n) for c in ("id", "label", "v")])
            if n < batch.num_rows and rows:
                chunk = chunk or Chunk(*(np.concatenate([r[c].to_numpy() for r in rows]) for c in (0, 1)), np.concatenate([matrix(r[2], dim) for r in rows]), turn, copies)
                for lo in range(n, batch.num_rows, ANCHORS):
                    if found := find(chunk, block(batch.slice(lo, ANCHORS))):
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], names=names)

    return run


def mine(rows: DataFrame, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the ids divisible by ``every``."""
    spark = rows.sparkSession
    own = common.stored(integers(rows, vec_id, embedding, label))
    dim, n = own.agg(F.max(F.size("v")), F.count("*")).first()
    dim = max(dim or 0, 1)
    turn = spark.sparkContext.broadcast(rotation(own, dim))
    chunks = max(-(-n * dim * 4 // CHUNK_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS)), 1)
    anchors = common.stored(own.where(F.col("id") % every == 0).withColumn("key", F.monotonically_increasing_id()))

    def searched(asked: DataFrame, find, copies: int, names: list[str]) -> DataFrame:
        extra = [c for c in asked.columns if c not in ("id", "label", "v", "key")]
        kinds = dict(asked.dtypes)
        dealt = own.select("id", "label", "v", F.lit(None).cast("long").alias("key"), *(F.lit(None).cast(kinds[c]).alias(c) for c in extra), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"))
        sent = asked.select("id", "label", "v", "key", *extra, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
        both = dealt.union(sent).repartitionById(chunks, F.col("chunk")).sortWithinPartitions(F.asc_nulls_first("key"))
        return both.drop("chunk").mapInArrow(common.tidy(_searched(turn, dim, find, copies, names)), ", ".join(f"{c} long" for c in names))

    def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "found"))).where(F.col("rank") <= k)

    positives = first(searched(anchors, _positives, POSITIVES + 1, ["key", "found", "score"]), ["key"], POSITIVES)
    lists = positives.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "found", "score"))).alias("p"))
    asked = common.stored(anchors.join(lists, "key").select("id", "label", "v", "key", F.col("p.score").alias("scores"), F.col("p.found").alias("found")))
    negatives = first(searched(asked.drop("found"), _negatives, NEGATIVES, ["key", "n", "found", "score"]), ["key", "n"], NEGATIVES)
    named = negatives.withColumnRenamed("found", "negative_id").join(asked.select("key", F.col("id").alias("anchor_id"), "scores", "found"), "key")
    at = lambda c: F.get(c, F.col("n").cast("int"))
    return named.select("anchor_id", at("found").alias("positive_id"), "rank", "negative_id", at("scores").alias("positive_score"), F.col("score").alias("negative_score"))


def op12(spark, sf_dir: str) -> DataFrame:
    return mine(relabelled(common.documents(spark, sf_dir, "embeddings")))


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, embedding, label, with the next label where an id is divisible by ``every``."""
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).alias("label"))


ORACLE = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
