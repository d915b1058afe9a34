"""Training steps by blocks of reads: gather, compute, scatter on a model that stays where it is.

Reads are packed into blocks of bounded size (a read longer than a block is cut, with the words around each cut on either
side, so windows lose nothing). In a step each block asks once for the vectors of its distinct words and negatives, one
kernel works on the whole block, and what comes back is one sum for each word of the block. All gradients are taken from
the model before the step.

The model is a table bucketed by word (``Params``). Requests and gradients are dealt out like its buckets, so joins move
those alone: the model's side of a plan has no exchange. A word that most reads hold is asked for once a block, not once
a position, so no bucket gets more than a row for each block and word.

A small model (``SHARED_FLOATS``) is sent to all tasks instead. Blocks then stay in the task that has them, or, where reads
are used for one step alone (``Params.step_of_reads``), are packed and used up there; a task sends one sum for each word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import vec as V
from strandloom.storage import checkpoint_dir, remove, stored

#: Centers of a block, and centers whose products are held at once.
POSITIONS, AT_ONCE = 8192, 2048
#: Blocks of a row group, as Spark's reader makes up to 4,096 rows of a group at once, 64 KB of words each.
GROUP_ROWS = 64
#: Floats of a model (both sides) that is sent to tasks; pairs of words up to which a block's products are made once for each pair.
SHARED_FLOATS, PAIRS = 1 << 20, 1 << 12

#: (reads, positions, parts, centers as numbers of words) -> numbers of the negatives, a row for each.
Draw = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]

_BLOCK = "block long, step int, read array<long>, start array<long>, left array<int>, size array<int>, length array<int>, whole array<boolean>, words array<long>"


def pack(reads: DataFrame, half_window: int, read: str = "read", words: str = "words", group: str | None = None) -> DataFrame:
    """Blocks of whole reads, or of pieces of long ones, in the order of rows; store them, as numbers of blocks depend on it.

    With a column ``group`` a block holds reads of one group (its ``step``); rows come ordered by it within their partition.

    A block lists its pieces: read, position of the first center, words before it that are no centers, centers, all words, and
    whether it is a whole read; ``words`` has the words of all pieces. A null read of words is an empty one.
    """
    return _taken(reads, read, words, group).mapInArrow(_packed(half_window), _BLOCK)


def kept(blocks: DataFrame) -> DataFrame:
    """Blocks stored in row groups of few rows, so that reading them takes little memory."""
    return stored(blocks, **{"parquet.block.row.count.limit": GROUP_ROWS})


def _taken(reads: DataFrame, read: str, words: str, group: str | None = None) -> DataFrame:
    return reads.select(F.col(read).cast("long"), F.col(words).cast("array<long>"), F.col(group).cast("int") if group else F.lit(0))


def _packed(half_window: int):
    names = [f.split(" ")[0] for f in _BLOCK.split(", ")]

    def run(batches):
        number, step, pieces, flat, held = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def block():
            cols = list(zip(*pieces))
            arrays = [pa.array([list(c)], pa.list_(t)) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([step], pa.int32()), *arrays, pa.array([np.concatenate(flat)], pa.list_(pa.int64()))], names=names)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(n)
            steps = batch.column(2).to_pylist() if batch.num_columns > 2 else [0] * len(n)
            for i, size, end, own_step in zip(ids.tolist(), n.tolist(), ends.tolist(), steps):
                own = values[end - size : end]
                if pieces and own_step != step:
                    yield block()
                    number, pieces, flat, held = number + 1, [], [], 0
                step = own_step
                for lo in range(0, max(size, 1), POSITIONS):
                    hi = min(size, lo + POSITIONS)
                    if pieces and (held + hi - lo > POSITIONS or len(pieces) >= POSITIONS):
                        yield block()
                        number, pieces, flat, held = number + 1, [], [], 0
                    a, z = max(0, lo - half_window), min(size, hi + half_window - 1)
                    pieces.append((i, lo, lo - a, hi - lo, z - a, size <= POSITIONS))
                    flat.append(own[a:z])
                    held += hi - lo
        if pieces:
            yield block()

    return run


class _Block:
    """The centers of a block with what stands around them."""

    def __init__(self, row: dict, half_window: int, skipgram: bool):
        get = lambda c: np.asarray(row[c])
        self.row, self.words, self.skipgram = row, get("words").astype(np.int64), skipgram
        size, left, length = get("size"), get("left"), get("length")
        first = np.cumsum(length) - length
        self.piece = np.repeat(np.arange(len(size)), size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.at = np.repeat(first + left, size) + within
        self.lo, self.hi = np.repeat(first, size), np.repeat(first + length, size)
        self.read, self.pos = get("read")[self.piece], np.repeat(get("start"), size) + within
        self.half_window, self.offsets = half_window, [o for o in range(-half_window, half_window) if o]

    @cached_property
    def valid(self) -> np.ndarray:
        return np.array([(self.at + o >= self.lo) & (self.at + o < self.hi) for o in self.offsets]).reshape(len(self.offsets), len(self.at))

    def around(self) -> np.ndarray:
        """How many words stand around each center."""
        return np.minimum(self.at - self.lo, self.half_window) + np.minimum(self.hi - 1 - self.at, self.half_window - 1)

    def times(self) -> np.ndarray:
        """How many centers each word stands around."""
        size, left, length = (np.asarray(self.row[c]).astype(np.int64) for c in ("size", "left", "length"))
        first = np.cumsum(length) - length + left
        lo, hi, at = np.repeat(first, length), np.repeat(first + size, length), np.arange(length.sum())
        last, start = np.minimum(at + self.half_window, hi - 1), np.maximum(at - self.half_window + 1, lo)
        return np.maximum(last - start + 1, 0) - ((at >= lo) & (at < hi))

    def updates(self):
        """(centers, their parts, offsets) of updates: one for each center, or with skip-gram one for each center and word around it."""
        if not self.skipgram:
            own = np.flatnonzero(self.valid.any(0))
            yield own, np.zeros(len(own), np.int64), self.offsets, self.valid[:, own]
            return
        part = np.cumsum(self.valid, axis=0) - 1
        for i, o in enumerate(self.offsets):
            own = np.flatnonzero(self.valid[i])
            yield own, part[i, own], [o], np.ones((1, len(own)), bool)

    def negatives(self, own: np.ndarray, part: np.ndarray, draw: Draw) -> np.ndarray:
        return draw(self.read[own], self.pos[own], part, self.words[self.at[own]])


def _rows(batch):
    """Rows of a batch or table of blocks, arrays as numpy."""
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() if c in ("block", "step") else batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in batch.schema.names}


def asked(blocks: DataFrame, half_window: int, skipgram: bool, draw: Draw | None) -> DataFrame:
    """block, word: the distinct words of each block, with the negatives that ``draw`` gives."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                b = _Block(row, half_window, skipgram)
                drawn = [b.negatives(own, part, draw).ravel() for own, part, _, _ in b.updates()] if draw else []
                words = _distinct(np.concatenate([b.words, *drawn]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), row["block"])), pa.array(words)], names=["block", "word"])

    return blocks.mapInArrow(run, "block long, word long")


@dataclass
class Step:
    """What a step does: rate, negatives and how a word's updates count (their sum, or with ``mean`` their mean)."""

    lr: float
    neg: int
    half_window: int
    draw: Draw
    skipgram: bool = False
    exact_sigmoid: bool = False
    mean: bool = False


def _narrow(words: np.ndarray, most: int) -> bool:
    """Whether words are small enough for an array with a place for each number."""
    return len(words) > 0 and words.min() >= 0 and words.max() < 4 * most + 1024


def _distinct(words: np.ndarray) -> np.ndarray:
    """``np.unique``, without a sort where words are small."""
    return np.flatnonzero(np.bincount(words)) if _narrow(words, len(words)) else np.unique(words)


def _places(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``np.searchsorted`` of words, by a table where they are small; a word that is not known is an error."""
    if not words.size:
        return np.zeros(words.shape, np.int64)
    if len(known) and known[0] == 0 and known[-1] == len(known) - 1:
        at, wrong = words, (words < 0) | (words >= len(known)) if words.min() < 0 or words.max() >= len(known) else None
    elif _narrow(known, words.size):
        table = np.full(int(known.max()) + 2, -1, np.int64)
        table[known] = np.arange(len(known))
        at = table[np.where(words < 0, len(table) - 1, np.minimum(words, len(table) - 1))]
        wrong = at < 0
    else:
        at = np.searchsorted(known, words)
        wrong = known[np.minimum(at, len(known) - 1)] != words if len(known) else np.ones(words.shape, bool)
    if wrong is not None and wrong.any():
        raise ValueError(f"no vector for word {words[wrong][0]}")
    return at


def _summed(at: np.ndarray, moves: np.ndarray, out: np.ndarray) -> None:
    """Adds each row of ``moves`` to row ``at`` of ``out``."""
    if len(at) and moves.shape[1] <= V.FEW_COMPONENTS:
        for d in range(moves.shape[1]):
            out[:, d] += np.bincount(at, weights=moves[:, d], minlength=len(out))
    elif len(at):
        order = np.argsort(at, kind="stable")
        rows, first = np.unique(at[order], return_index=True)
        out[rows] += np.add.reduceat(moves[order], first, axis=0)


def _scores(x: np.ndarray, exact: bool) -> tuple[np.ndarray, Callable]:
    if exact:
        return 1 / (1 + np.exp(-x)), np.log
    step = np.floor((np.clip(x, -V.MAX_SIGMOID, V.MAX_SIGMOID) + V.MAX_SIGMOID) * V.TABLE_SIZE / (2 * V.MAX_SIGMOID))
    score = 1 / (1 + np.exp(-(step * (2.0 * V.MAX_SIGMOID / V.TABLE_SIZE) - V.MAX_SIGMOID)))
    score = np.where(x < -V.MAX_SIGMOID, 0.0, np.where(x > V.MAX_SIGMOID, 1.0, score))
    return score, lambda p: np.log((np.floor(p * V.TABLE_SIZE) + V.LOG_SHIFT) / V.TABLE_SIZE)


def _by_pairs(block: _Block, known: np.ndarray, wi: np.ndarray, wo: np.ndarray, s: Step) -> tuple[np.ndarray, ...] | None:
    """``kernel`` for few words and the exact sigmoid, in which exp(-x) is a product of one factor for each word of the context.

    Factors are made once for each pair of a word and a target, or of some words and a target, and rates are summed by such pairs before
    they meet vectors. None where factors are too large or too small for that.
    """
    n, most = len(known), 1 if s.skipgram else 2 * s.half_window - 1
    products = wi @ wo.T
    if not np.abs(products).max() * (s.neg + 1) < 600:
        return None
    words, times = _places(known, block.words), block.times()
    n_in = np.bincount(words, weights=times, minlength=n).astype(np.int64)
    n_out, inner, outer = np.zeros(n, np.int64), np.zeros((n, n)), np.zeros((n, n))
    loss, updates = np.zeros(len(block.at)), np.zeros(len(block.at), np.int64)

    def rates(own: np.ndarray, part: np.ndarray, codes: list[np.ndarray], factors: list[np.ndarray]) -> list[np.ndarray]:
        """Sums of rates by codes of words and target, for updates of the centers ``own``."""
        drawn = _places(known, block.negatives(own, part, s.draw))
        sums, right = [np.zeros(f.size) for f in factors], None
        first = [c * n for c in codes]
        for j in range(s.neg + 1):
            target = words[block.at[own]] if j == 0 else drawn[:, j - 1]
            n_out[:] += np.bincount(target, minlength=n)
            at = [c + target for c in first]
            score = 1 / (1 + reduce(np.multiply, (f.take(a) for f, a in zip(factors, at))))
            other = 1 - score
            right, alpha = (score, s.lr * other) if j == 0 else (right * other, -s.lr * score)
            for total, a in zip(sums, at):
                total += np.bincount(a, weights=alpha, minlength=len(total))
        loss[own] -= np.log(right) / s.neg
        updates[own] += 1
        return sums

    # Centers with all of their context, some places at once.
    factor, group = np.exp(-products / most), 1
    while n > 1 and n ** (group + 2) <= PAIRS and group < most:
        group += 1
    size = block.around()
    whole = [(own, part, offsets) for own, part, offsets, _ in block.updates()] if s.skipgram else [(np.flatnonzero(size == most), None, block.offsets)]
    for own, part, offsets in whole:
        codes, factors, at = [], [], block.at[own]
        for lo in range(0, len(offsets), group):
            code, every = 0, np.ones((1, n))
            for o in offsets[lo : lo + group]:
                code, every = code * n + words[at + o], (every[:, None, :] * factor).reshape(-1, n)
            codes.append(code)
            factors.append(every.ravel())
        for total in rates(own, np.zeros(len(own), np.int64) if part is None else part, codes, factors):
            total = total.reshape(-1, n, n)
            while total.size:
                inner += total.sum(0)
                outer += total.sum(0) / most
                if len(total) == 1:
                    break
                total = total.sum(1).reshape(-1, n, n)
    # Centers near an end of a read: one place at a time, by words of the context; word ``n`` stands for places outside.
    own = np.flatnonzero((size > 0) & (size < most)) if not s.skipgram else size[:0]
    if len(own):
        held = np.arange(1, most)[:, None, None]
        factor = np.exp(-np.concatenate([products, np.zeros((1, n))]) / held).ravel()
        at, lo, hi, first = block.at[own], block.lo[own], block.hi[own], (size[own] - 1) * (n + 1)
        around = [np.where((at + o >= lo) & (at + o < hi), words.take(at + o, mode="wrap"), n) + first for o in block.offsets]
        for total in rates(own, np.zeros(len(own), np.int64), around, [factor] * len(around)):
            total = total.reshape(most - 1, n + 1, n)[:, :n]
            inner += total.sum(0)
            outer += (total / held).sum(0)
    return inner @ wo, outer.T @ wi, n_in, n_out, loss, updates


def kernel(block: _Block, known: np.ndarray, wi: np.ndarray, wo: np.ndarray, s: Step) -> tuple[np.ndarray, ...]:
    """(input moves, output moves, times of each, loss of each center, updates of each center)."""
    if s.exact_sigmoid and 0 < len(known) ** 2 <= PAIRS and (found := _by_pairs(block, known, wi, wo, s)):
        return found
    at = _places(known, block.words)
    d_in, d_out = np.zeros_like(wi), np.zeros_like(wo)
    n_in, n_out = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    # The last row stands for places outside of a read.
    spread, times = np.zeros((len(at) + 1, wi.shape[1])), np.zeros(len(at) + 1, np.int64)
    around = np.concatenate([wi[at], np.zeros((1, wi.shape[1]))])
    loss, updates = np.zeros(len(block.at)), np.zeros(len(block.at), np.int64)
    for every, part, offsets, valid in block.updates():
        drawn = _places(known, block.negatives(every, part, s.draw))
        for lo in range(0, len(every), AT_ONCE):
            own, ok = every[lo : lo + AT_ONCE], valid[:, lo : lo + AT_ONCE]
            center = block.at[own]
            hidden = np.zeros((len(own), wi.shape[1]))
            places = [np.where(v, center + o, len(at)) for o, v in zip(offsets, ok)]
            for p in places:
                hidden += around.take(p, axis=0)
            hidden /= ok.sum(0)[:, None]
            target = np.concatenate([at[center][:, None], drawn[lo : lo + AT_ONCE]], axis=1)
            held = wo[target]
            score, log = _scores(np.einsum("ijd,id->ij", held, hidden), s.exact_sigmoid)
            right = np.arange(s.neg + 1) == 0
            alpha = s.lr * (right - score)
            grad = np.einsum("ij,ijd->id", alpha, held)
            _summed(target.ravel(), (alpha[:, :, None] * hidden[:, None, :]).reshape(-1, hidden.shape[1]), d_out)
            n_out += np.bincount(target.ravel(), minlength=len(known))
            for p in places:
                spread[p] += grad
                times[p] += 1
            loss[own] -= log(np.where(right, score, 1 - score)).sum(1) / s.neg
            updates[own] += 1
    _summed(at, spread[:-1], d_in)
    n_in += np.bincount(at, weights=times[:-1], minlength=len(known)).astype(np.int64)
    return d_in, d_out, n_in, n_out, loss, updates


#: Moves are whole multiples of 2**-32, so that their sums are exact and don't depend on order or partitions.
UNITS = 1 << 32

_MOVES = "word long, di array<long>, do array<long>, ni long, no long, read long, loss double, n long, reads long"


def _units(m: np.ndarray) -> np.ndarray:
    if not (np.abs(m) < UNITS >> 2).all():
        raise ValueError("a move is not finite, or too large to sum")
    return np.rint(m * UNITS).astype(np.int64)


def _lists(m: np.ndarray) -> pa.Array:
    units = m if m.dtype == np.int64 else _units(m)
    return pa.FixedSizeListArray.from_arrays(pa.array(units.ravel()), m.shape[1]).cast(pa.list_(pa.int64()))


_MOVES_SCHEMA = pa.schema([("word", pa.int64()), ("di", pa.list_(pa.int64())), ("do", pa.list_(pa.int64())), ("ni", pa.int64()), ("no", pa.int64()), ("read", pa.int64()), ("loss", pa.float64()), ("n", pa.int64()), ("reads", pa.int64())])


def _word_rows(known: np.ndarray, d_in: np.ndarray, d_out: np.ndarray, n_in: np.ndarray, n_out: np.ndarray) -> pa.Table:
    """Rows of the words that move."""
    own = np.flatnonzero(n_in + n_out)
    nulls = [pa.nulls(len(own), t) for t in _MOVES_SCHEMA.types[5:]]
    return pa.Table.from_arrays([pa.array(known[own]), _lists(d_in[own]), _lists(d_out[own]), pa.array(n_in[own]), pa.array(n_out[own]), *nulls], schema=_MOVES_SCHEMA)


def _loss_rows(block: _Block, loss: np.ndarray, updates: np.ndarray) -> list[tuple]:
    """read, loss, n, reads: a read's own sum where it is cut, else the sum of means of reads."""
    reads, whole = np.asarray(block.row["read"]), np.asarray(block.row["whole"], bool)
    # With skip-gram a read's mean is over its pairs, else over its words (those without context count, with loss 0).
    count = np.bincount(block.piece, weights=updates if block.skipgram else None, minlength=len(reads)).astype(np.int64)
    total = np.bincount(block.piece, weights=loss, minlength=len(reads))
    cut = np.flatnonzero(~whole)
    mean = float((total[whole] / np.maximum(count[whole], 1)).sum())
    return [(None, mean, None, int(whole.sum())), *((int(reads[i]), float(total[i]), int(count[i]), None) for i in cut)]


def _loss_table(rows: list[tuple]) -> pa.Table:
    tail = [pa.array(list(c), t) for c, t in zip(zip(*rows), _MOVES_SCHEMA.types[5:])]
    return pa.Table.from_arrays([*(pa.nulls(len(rows), t) for t in _MOVES_SCHEMA.types[:5]), *tail], schema=_MOVES_SCHEMA)


def _moves(s: Step):
    """A block and the vectors that it asked for -> a row for each word that moves, and for losses."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in _rows(left.combine_chunks()):
            block = _Block(row, s.half_window, s.skipgram)
            word = right.column("word").to_numpy()
            order = np.argsort(word)
            known, dim = word[order], len(right.column("wi")[0]) if len(word) else 1
            wi, wo = (right.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(word), dim)[order].astype(float) for c in ("wi", "wo"))
            *moves, loss, updates = kernel(block, known, wi, wo, s)
            out += [_word_rows(known, *moves), _loss_table(_loss_rows(block, loss, updates))]
        return pa.concat_tables(out) if out else _MOVES_SCHEMA.empty_table()

    return run


def _moves_in_place(s: Step, shared, packed: Callable | None = None):
    """Blocks, or reads that ``packed`` makes blocks of -> a row for each word that moves in a task, and for losses of each block."""

    def run(batches):
        known, wi, wo = shared.value
        sums = [np.zeros(wi.shape, np.int64), np.zeros(wo.shape, np.int64), np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)]
        losses = []
        for batch in packed(batches) if packed else batches:
            for row in _rows(batch):
                block = _Block(row, s.half_window, s.skipgram)
                *moves, loss, updates = kernel(block, known, wi, wo, s)
                # Blocks are rounded one by one, as where they are summed by Spark.
                for total, own in zip(sums, moves):
                    total += own if own.ndim == 1 else _units(own)
                losses += _loss_rows(block, loss, updates)
            if len(losses) >= 1024:
                yield from _loss_table(losses).to_batches()
                losses = []
        if losses:
            yield from _loss_table(losses).to_batches()
        yield from _word_rows(known, *sums).to_batches()

    return run


class Params:
    """A model table (word, wi, wo) in buckets by word, in the folder that executors share. Each step writes a new one."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int, dim: int, rows: int | None = None):
        self.spark, self.name, self.path, self.buckets, self.dim, self.rows = spark, name, path, buckets, dim, rows

    @classmethod
    def create(cls, model: DataFrame, dim: int, buckets: int | None = None) -> Params:
        spark = model.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        return cls._written(spark, model.repartition(n, "word"), dim, n)

    @classmethod
    def _written(cls, spark: SparkSession, rows: DataFrame, dim: int, buckets: int, count: int | None = None) -> Params:
        name = f"params_{uuid.uuid4().hex}"
        path = f"{checkpoint_dir(spark)}/{name}"
        rows.select("word", F.col("wi").cast("array<double>"), F.col("wo").cast("array<double>")).write.bucketBy(buckets, "word").sortBy("word").option("path", path).saveAsTable(name)
        return cls(spark, name, path, buckets, dim, count)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)

    def gathered(self, requests: DataFrame) -> DataFrame:
        """``requests`` (with a column ``word``) with the vectors of their words. A word that the table lacks ends the job."""
        out = requests.repartition(self.buckets, "word").join(self.table(), "word", "left")
        return out.withColumn("wi", F.coalesce("wi", F.raise_error(F.concat(F.lit("no vector for word "), F.col("word").cast("string"))).cast("array<double>")))

    def moved(self, moves: DataFrame, mean: bool) -> DataFrame:
        """The table after ``moves`` (word, di, do, ni, no)."""
        dealt = moves.repartition(self.buckets, "word").groupBy("word")
        total = lambda c: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(self.dim))).alias(c)
        sums = dealt.agg(total("di"), total("do"), F.sum("ni").alias("ni"), F.sum("no").alias("no"))
        over = lambda d, n: F.transform(d, lambda x: x / UNITS / F.greatest(n, F.lit(1)) if mean else x / UNITS).alias(d)
        sums = sums.select("word", over("di", F.col("ni")), over("do", F.col("no")))
        return self.table().join(sums, "word", "left").select("word", *(F.coalesce(V.add(w, d), F.col(w)).alias(w) for w, d in (("wi", "di"), ("wo", "do"))))

    def shared(self):
        """A small model's words in order, and their vectors, as a broadcast; None for a larger one."""
        if self.rows is None:
            self.rows = self.table().count()
        if 2 * self.rows * self.dim > SHARED_FLOATS:
            return None
        rows = self.table().orderBy("word").toArrow()
        matrix = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim)
        return self.spark.sparkContext.broadcast((rows.column("word").to_numpy(), matrix("wi"), matrix("wo")))

    def step(self, blocks: DataFrame, s: Step) -> tuple[Params, DataFrame]:
        """(the table after one step, losses): losses are stored rows of ``mean_loss``."""
        shared = self.shared()
        if shared:
            return self._after(blocks.mapInArrow(_moves_in_place(s, shared), _MOVES), s, shared)
        vectors = self.gathered(asked(blocks, s.half_window, s.skipgram, s.draw))
        return self._after(blocks.groupBy("block").cogroup(vectors.groupBy("block")).applyInArrow(_moves(s), _MOVES), s)

    def step_of_reads(self, reads: DataFrame, s: Step, read: str = "read", words: str = "words", made: Callable | None = None) -> tuple[Params, DataFrame]:
        """``step`` of the blocks of reads that no other step takes: with a small model, blocks are not stored.

        ``made`` makes Arrow batches of (``read``, ``words``) such of numbers and arrays of words, in the same task.
        """
        shared = self.shared()
        if not shared:
            reads = reads.select(F.col(read).cast("long"), words).mapInArrow(made, "read long, words array<long>") if made else reads.select(F.col(read).alias("read"), F.col(words).alias("words"))
            return self.step(kept(pack(reads, s.half_window)), s)
        packed = _packed(s.half_window)
        if made:
            return self._after(reads.select(F.col(read).cast("long"), words).mapInArrow(_moves_in_place(s, shared, lambda batches: packed(made(batches))), _MOVES), s, shared)
        return self._after(_taken(reads, read, words).mapInArrow(_moves_in_place(s, shared, packed), _MOVES), s, shared)

    def _after(self, found: DataFrame, s: Step, shared=None) -> tuple[Params, DataFrame]:
        held = stored(found, _MOVES)
        if shared:
            shared.unpersist()
        new = self._written(self.spark, self.moved(held.where("word IS NOT NULL"), s.mean), self.dim, self.buckets, self.rows)
        return new, held.where("word IS NULL").select("read", "loss", "n", "reads")


def mean_loss(losses: DataFrame) -> DataFrame:
    """loss, reads: mean of reads' mean losses, from rows of ``Params.step``; reads that were cut are summed up first. Sums are exact, so they don't depend on partitions."""
    cut = losses.where("read IS NOT NULL").groupBy("read").agg((V.exact_sum("loss") / F.greatest(F.sum("n"), F.lit(1))).alias("loss")).agg(V.exact_sum("loss").alias("loss"), F.count("*").alias("reads"))
    both = losses.where("read IS NULL").select("loss", "reads").union(cut)
    return both.agg((F.coalesce(V.exact_sum("loss"), F.lit(0.0)) / F.greatest(F.sum("reads"), F.lit(1))).alias("loss"), F.sum("reads").alias("reads"))


def renamed(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """Blocks with the numbers that ``names`` (word, rank) gives to words in place of the words."""
    found = asked(blocks, 1, False, None).join(names, "word")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        word, rank = right.column("word").to_numpy(), right.column("rank").to_numpy()
        order = np.argsort(word)
        words = left.column("words").combine_chunks()
        new = rank[order][np.searchsorted(word[order], words.flatten().to_numpy(zero_copy_only=False))] if len(word) else np.zeros(0, np.int64)
        at = left.schema.get_field_index("words")
        return left.set_column(at, left.schema.field(at), pa.ListArray.from_arrays(pa.array(np.array([0, len(new)], np.int32)), pa.array(new, pa.int64())))

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, _BLOCK)


def hashed_draw(vocabulary: int, neg: int, seed: int, epoch: int) -> Draw:
    """Negatives among the numbers 0 to ``vocabulary`` - 1 without the center, always the same for the same update."""
    if vocabulary < 2:
        raise ValueError("negatives need two words or more")

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def draw(read, pos, part, center):
        with np.errstate(over="ignore"):
            h = mixed(np.full(len(read), (seed * 1_000_003 + epoch) % 2**64, np.uint64))
            for x in (read, pos, part):
                h = mixed(h ^ mixed(x.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
            h = mixed(h[:, None] + np.arange(1, neg + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        r = (h % np.uint64(vocabulary - 1)).astype(np.int64)
        return r + (r >= center[:, None])

    return draw


def congruent_draw(vocabulary: int, neg: int, number: Callable) -> Draw:
    """The same by the linear congruence of ``context.negatives_lcg``; ``number(reads, positions)`` tells updates apart."""

    def draw(read, pos, part, center):
        first = number(read, pos) * 1103515245
        found = np.empty((neg, len(first)), np.int64)
        for i, r in enumerate(found):
            np.remainder((first + 12345 * (i + 1)) & 2147483647, vocabulary - 1, out=r)
            r += r >= center
        return found.T

    return draw
