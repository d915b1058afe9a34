"""Random-hyperplane LSH of k-mers: fit, apply, and the file form.

A plane has complex weights by k-mer position and a threshold. Letters are encoded A -1, T +1, C -i, G +i, and only real
parts are compared, so a weight a + bi is four real weights: A -a, T +a, C +b, G -b. Bit s of a hash is set where the
weighted sum of plane s is over its threshold.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators.context import order_key
from strandloom.storage import read_bytes, write_bytes

MAGIC = 0x201902  # of the file form (fixed value)
MAX_BITS = 31
LETTERS = "ATCG"
#: Column form up to so many (position, plane) terms; beyond, generated code gets too long.
COLUMN_TERMS = 96


@dataclass
class Planes:
    """Complex weights (k, bits) and thresholds (bits)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self.weights = np.asarray(self.weights, complex)
        self.thresholds = np.asarray(self.thresholds, complex)
        if self.weights.ndim != 2 or self.thresholds.shape != (self.weights.shape[1],):
            raise ValueError("weights are (k, bits), thresholds (bits)")
        if not 1 <= self.bits <= MAX_BITS or self.k < 1:
            raise ValueError(f"planes have 1 to {MAX_BITS} bits and k of 1 or more")

    @property
    def k(self) -> int:
        return self.weights.shape[0]

    @property
    def bits(self) -> int:
        return self.weights.shape[1]

    def real(self) -> np.ndarray:
        """Real weights (k, 4, bits) for the letters A, T, C, G."""
        a, b = self.weights.real, self.weights.imag
        return np.stack([-a, a, b, -b], axis=1)

    def rows(self) -> list[tuple[int, str, int, float]]:
        """(pos, base, spoke, w)."""
        w = self.real()
        return [(p, c, s, float(w[p, i, s])) for p in range(self.k) for i, c in enumerate(LETTERS) for s in range(self.bits)]

    def hash(self, kmer: str, both: bool = False) -> int:
        """Hash of one k-mer; with ``both``, the lesser of its and its reverse complement's."""
        if len(kmer) != self.k or set(kmer) - set(LETTERS):
            raise ValueError(f"{kmer!r} is not a {self.k}-mer")
        w = self.real()

        def one(x):
            s = sum(w[p, LETTERS.index(c)] for p, c in enumerate(x))
            return int(((s > self.thresholds.real) * (1 << np.arange(self.bits))).sum())

        return min(one(kmer), one(kmer.translate(str.maketrans("ACGT", "TGCA"))[::-1])) if both else one(kmer)

    def to_bytes(self) -> bytes:
        flat = lambda z: np.ascontiguousarray(z, "<c16").tobytes()
        head = struct.pack("<iii", MAGIC, self.bits, self.k)
        return head + (1 << np.arange(self.bits, dtype="<u8")).tobytes() + flat(self.thresholds) + flat(self.weights)

    @classmethod
    def from_bytes(cls, data: bytes) -> Planes:
        if len(data) < 12 or struct.unpack_from("<i", data)[0] != MAGIC:
            raise ValueError("not a plane file")
        bits, k = struct.unpack_from("<ii", data, 4)
        if bits < 1 or k < 1 or len(data) != 12 + 24 * bits + 16 * k * bits:
            raise ValueError("plane file has a wrong size")
        z = np.frombuffer(data, "<c16", offset=12 + 8 * bits)
        return cls(z[bits:].reshape(k, bits).copy(), z[:bits].copy())

    def save(self, path: str, spark=None) -> None:
        """To a local path, or with a session to any store that it writes."""
        if spark:
            return write_bytes(spark, path, self.to_bytes())
        with open(path, "wb") as f:
            f.write(self.to_bytes())

    @classmethod
    def load(cls, path: str, spark=None) -> Planes:
        if spark:
            return cls.from_bytes(read_bytes(spark, path))
        with open(path, "rb") as f:
            return cls.from_bytes(f.read())


def encode(kmer: str) -> np.ndarray:
    """Complex letters; an unknown one is 0."""
    return np.array([{"A": -1, "T": 1, "C": -1j, "G": 1j}.get(c, 0) for c in kmer], complex)


#: Singular values under this share of the greatest count as zero.
TINY = 1e-10


def plane_through(kmers: list[str]) -> tuple[np.ndarray, complex]:
    """Weights and threshold from k encoded k-mers: the conjugate of a unit null vector of the rows with -1 added and a zero row.

    Of all null vectors (their phase is free, and there are more where k-mers repeat) it is the one nearest to the axis of the
    threshold, or to the first axis that they don't stand upright on: its component there is real and positive. So
    it does not depend on how a machine's library picks singular vectors.
    """
    k = len(kmers[0])
    m = np.zeros((k + 1, k + 1), complex)
    for i, x in enumerate(kmers[:k]):
        m[i, :k], m[i, k] = encode(x), -1
    _, size, rows = np.linalg.svd(m)
    null = rows[size <= TINY * max(size[0], 1)].conj().T
    for axis in [k, *range(k)]:
        near = null @ null[axis].conj()
        if (length := np.linalg.norm(near)) > 1e-6:
            v = (near / length).conj()
            return v[:k], v[k]
    raise ValueError("no null vector")


def residuals(planes: Planes, kmers: list[str]) -> np.ndarray:
    """How far each k-mer is off each plane: |encoded . conj(weights) - conj(threshold)|, a row for each k-mer."""
    return np.abs(np.array([encode(x) for x in kmers]) @ planes.weights.conj() - planes.thresholds.conj())


def chosen(n: int, k: int, plane: int, seed: int = 0) -> list[int]:
    """The k of n sampled k-mers that a plane goes through: those with the smallest MD5 sums of (seed, plane, number)."""
    return sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{plane}:{i}".encode()).digest())[:k]


def fit_planes(kmers: list[str], bits: int, seed: int = 0, indices: list[list[int]] | None = None) -> Planes:
    """Planes through k keyed k-mers each; ``indices`` says which instead. The same k-mers give the same planes on any machine, up to rounding."""
    if not kmers:
        raise ValueError("no k-mers to fit planes to")
    own = indices or [chosen(len(kmers), len(kmers[0]), s, seed) for s in range(bits)]
    found = [plane_through([kmers[i] for i in c]) for c in own]
    return Planes(np.stack([p for p, _ in found], axis=1), np.array([c for _, c in found]))


#: Tries for each read where one each does not give enough k-mers.
TRIES = 64


def sampled(reads: DataFrame, k: int, n: int, seed: int = 0, seq: str = "seq", keys: list[str] | None = None, tries: int = 1) -> DataFrame:
    """key, try, kmer: the ``n`` smallest keys among the tries of all reads of more than k letters.

    A try is a place in a read, both drawn by MD5 sums of (seed, ``keys`` of the read, try), and counts if its k-mer (made
    canonical) has no N. Each task keeps its n smallest, and those of all tasks are merged: one pass, no sort of the table, and the same
    sample on each retry and for any partitioning. Without ``keys`` a read is told by its letters.
    """
    letters = S.normalize_sequence(seq)
    own = F.concat_ws(":", *(F.col(c).cast("string") for c in keys)) if keys else F.md5(letters)
    fit = reads.select(letters.alias("s"), own.alias("_id")).where(F.length("s") > k)
    fit = fit.select("s", "_id", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    start = F.pmod(order_key("_id", "try", F.lit("start"), seed=seed), F.length("s") - k).cast("int")
    kmers = fit.select(order_key("_id", "try", seed=seed).alias("key"), "_id", "try", S.canonical_kmer(F.substring("s", start + 1, F.lit(k))).alias("kmer")).where(~F.col("kmer").contains("N"))
    return kmers.orderBy("key", "_id", "try").limit(n).select("key", "try", "kmer")


def sample_kmers(reads: DataFrame, k: int, bits: int, seed: int = 0, seq: str = "seq", keys: list[str] | None = None) -> list[str]:
    """2 * k * bits canonical k-mers without N: reads drawn alike, then a place in each. Brings only these to the driver."""
    want = 2 * k * bits
    for tries in (1, TRIES):
        out = [r.kmer for r in sampled(reads, k, want, seed, seq, keys, tries).collect()]
        if len(out) == want:
            return out
    if not out:
        raise ValueError(f"no read has a {k}-mer without N and more than {k} letters")
    return (out * (want // len(out) + 1))[:want]


def build_planes(reads: DataFrame, k: int, bits: int, seed: int = 0, seq: str = "seq", keys: list[str] | None = None) -> Planes:
    return fit_planes(sample_kmers(reads, k, bits, seed, seq, keys), bits, seed)


def lsh_hash(kmer, planes: Planes, both: bool = False) -> Column:
    """Hash as a Column, null for a k-mer of another length or with other letters. For few planes; see ``hash_reads``."""
    if planes.k * planes.bits > COLUMN_TERMS:
        raise ValueError("too many terms for a column expression; use hash_reads or hash_joined")
    kmer = F.col(kmer) if isinstance(kmer, str) else kmer
    w = planes.real()

    def one(x: Column) -> Column:
        total = None
        for s in range(planes.bits):
            terms = None
            for p in range(planes.k):
                at = F.call_function("locate", F.substring(x, p + 1, 1), F.lit(LETTERS))
                term = F.element_at(F.array(*(F.lit(float(v)) for v in w[p, :, s])), at)
                terms = term if terms is None else terms + term
            bit = F.when(terms > float(planes.thresholds[s].real), F.lit(1 << s).cast("long")).otherwise(F.lit(0).cast("long"))
            total = bit if total is None else total + bit
        return total

    value = F.least(one(kmer), one(S.reverse_complement(kmer))) if both else one(kmer)
    return F.when((F.length(kmer) == planes.k) & kmer.rlike("^[ACGT]+$"), value)


def hash_joined(kmers: DataFrame, planes: Planes, keys: list[str], kmer: str = "kmer") -> DataFrame:
    """``keys`` and ``word``: letters joined to the plane table, sums by plane, bits by k-mer, for each distinct k-mer once; then words are joined to k-mers.

    The table has 4 * k * bits rows (k and bits are bounded), so it is broadcast, and so are words where few k-mers are possible.
    """
    spark = kmers.sparkSession
    table = spark.createDataFrame(planes.rows(), "_pos int, _base string, _spoke int, w double")
    limits = spark.createDataFrame([(s, float(c.real)) for s, c in enumerate(planes.thresholds)], "_spoke int, c double")
    once = kmers.where(F.length(kmer) == planes.k).select(F.col(kmer).alias("_kmer")).distinct()
    letters = once.select("_kmer", F.posexplode(F.split("_kmer", "")).alias("_pos", "_base"))
    sums = letters.join(F.broadcast(table), ["_pos", "_base"]).groupBy("_kmer", "_spoke").agg(F.sum("w").alias("w"))
    bits = sums.join(F.broadcast(limits), "_spoke").withColumn("bit", F.when(F.col("w") > F.col("c"), F.expr("shiftleft(1L, _spoke)")).otherwise(F.lit(0).cast("long")))
    named = bits.groupBy("_kmer").agg(F.sum("bit").alias("word"))
    named = F.broadcast(named) if 4**planes.k <= TABLE else named
    return kmers.join(named, F.col(kmer) == F.col("_kmer")).select(*keys, "word")


_CODE = np.full(256, 4, np.int8)
for _i, _l in enumerate(LETTERS):
    _CODE[ord(_l)] = _CODE[ord(_l.lower())] = _i
_SWAP = np.array([1, 0, 3, 2, 4], np.int8)
#: Place of A, T, C, G in the alphabet.
_RANK = np.array([0, 3, 1, 2, 9], np.int8)


#: Up to so many possible k-mers each is hashed once.
TABLE = 1 << 16


def _hash_at(code: np.ndarray, at: np.ndarray, planes: Planes, canonical: bool) -> np.ndarray:
    """Words of the k-mers that start at ``at``."""
    k = planes.k
    w, limit, power = planes.real(), planes.thresholds.real, 1 << np.arange(planes.bits, dtype=np.int64)
    flip = np.zeros(len(at), bool)
    if canonical:
        open_ = np.ones(len(at), bool)
        for p in range(k):
            a, b = _RANK[code[at + p]], _RANK[_SWAP[code[at + k - 1 - p]]]
            flip |= open_ & (b < a)
            open_ &= a == b
            if not open_.any():
                break
    sums = np.zeros((len(at), planes.bits))
    for p in range(k):
        letter = np.where(flip, _SWAP[code[at + k - 1 - p]], code[at + p]) if canonical else code[at + p]
        sums += w[p][letter]
    return (sums > limit) @ power


def _table(planes: Planes, canonical: bool, block: int) -> np.ndarray:
    """Words of all k-mers, by the base-4 number of their letters; made once a worker and set of planes."""
    held = planes.__dict__.setdefault("_tables", {})
    if canonical not in held:
        k = planes.k
        every = (np.arange(4**k)[:, None] >> (2 * np.arange(k - 1, -1, -1)) & 3).astype(np.int8).ravel()
        starts = np.arange(4**k) * k
        held[canonical] = np.concatenate([_hash_at(every, starts[lo : lo + block], planes, canonical) for lo in range(0, len(starts), block)])
    return held[canonical]


def hash_arrays(data: np.ndarray, offs: np.ndarray, planes: Planes, canonical: bool = True, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets by read) of all k-mers of many reads, given as bytes and offsets; k-mers with other letters are left out."""
    k, code = planes.k, _CODE[data]
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    bad = np.concatenate([[0], np.cumsum(code == 4)])
    ok = bad[k:] == bad[:-k]
    for end in offs[1:-1]:
        ok[max(0, end - k + 1) : end] = False
    starts = np.flatnonzero(ok)
    if 4**k <= TABLE and 4**k <= len(starts):
        number = np.zeros(n, np.int32)
        for p in range(k):
            number *= 4
            number += code[p : p + n]
        return _table(planes, canonical, block)[number[starts]], np.searchsorted(starts, offs)
    out = np.empty(len(starts), np.int64)
    for lo in range(0, len(starts), block):
        out[lo : lo + block] = _hash_at(code, starts[lo : lo + block], planes, canonical)
    return out, np.searchsorted(starts, offs)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


#: Letters that are hashed at once.
SLICE_BYTES = 1 << 20


def _slices(offs: np.ndarray):
    """(first, after the last) of reads with about ``SLICE_BYTES`` letters; a longer read is a slice of its own."""
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi
        lo = hi


def hash_pieces(data: np.ndarray, offs: np.ndarray, planes: Planes, canonical: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``hash_arrays``, with reads of more than ``SLICE_BYTES`` letters in pieces that share k - 1 letters."""
    if len(data) <= SLICE_BYTES or len(offs) > 2:
        return hash_arrays(data, offs, planes, canonical)
    words = [hash_arrays(data[lo : lo + SLICE_BYTES + planes.k - 1], np.array([0, min(len(data) - lo, SLICE_BYTES + planes.k - 1)]), planes, canonical)[0] for lo in range(0, len(data), SLICE_BYTES)]
    flat = np.concatenate(words)
    return flat, np.array([0, len(flat)])


def hash_batches(shared, canonical: bool = True):
    """What makes Arrow batches whose last column are reads such with their words in its place; ``shared`` is a broadcast of planes."""

    def run(batches):
        p = shared.value
        for batch in batches:
            names = [*batch.schema.names[:-1], "words"]
            data, offs = _bytes_of(batch.column(batch.num_columns - 1))
            for lo, hi in _slices(offs):
                words, cuts = hash_pieces(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], p, canonical)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(words))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), lists], names=names)

    return run


def hash_reads(reads: DataFrame, planes: Planes, keys: list[str], seq: str = "seq", canonical: bool = True) -> DataFrame:
    """``keys`` and ``words``: a read's k-mers, made canonical and hashed in one step on Arrow batches, in order.

    A null read, and one without a k-mer, has no words. Letters other than ACGT (either case) part k-mers.
    """
    src = reads.select(*keys, F.col(seq).alias("_seq"))
    schema = src.drop("_seq").withColumn("words", F.array().cast("array<long>")).schema
    return src.mapInArrow(hash_batches(reads.sparkSession.sparkContext.broadcast(planes), canonical), schema)


def word_counts(reads: DataFrame, planes: Planes, seq: str = "seq", canonical: bool = True) -> DataFrame:
    """word, n: how often a word stands in a batch of reads, so words come more than once; sum them up. For streams too."""
    shared = reads.sparkSession.sparkContext.broadcast(planes)

    def run(batches):
        p = shared.value
        for batch in batches:
            data, offs = _bytes_of(batch.column(0))
            for lo, hi in _slices(offs):
                words = hash_pieces(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], p, canonical)[0]
                if p.bits <= 16:
                    n = np.bincount(words, minlength=1)
                    own = np.flatnonzero(n)
                    n = n[own]
                else:
                    own, n = np.unique(words, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return reads.select(seq).mapInArrow(run, "word long, n long")
