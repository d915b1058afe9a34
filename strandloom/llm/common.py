"""Shared pieces: reading tables, walking Arrow batches in bounded slices, vectorised word hashing.

Words are found and hashed on the UTF-8 bytes of many texts at once, without a Python object for each word.
A slice holds whole texts, about ``SLICE_BYTES`` of them (one longer text makes a slice of its own), so that memory
stays bounded by the largest text.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strandloom.storage import checkpoint_dir

SLICE_BYTES = 1 << 19
U64 = np.uint64


#: Rows of an Arrow batch, where the session has Spark's own 10,000: batches are held by the JVM and by Python at once.
BATCH_ROWS = 1000


def small_batches(spark) -> None:
    """Lower the session's Arrow batches, unless somebody has set them; plans are made after operators return, so this stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def documents(spark, sf_dir: str, table: str = "documents"):
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df, schema=None):
    """``df`` written as Parquet to the shared checkpoint folder and read again: cuts lineage, and size estimates with it."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def counted(df, schema: str | None = None, **sums) -> tuple:
    """(``stored`` rows, a dict of their number, ``rows``, and of the sums asked for), summed while they are written, so without jobs of their own."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items())), schema or df.schema)
    return out, seen.get


def release(spark) -> None:
    """Lets Spark drop what finished jobs have sent and shuffled: it does so when the driver collects its garbage, which a driver with little to do puts off."""
    gc.collect()
    spark._jvm.System.gc()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _trim():
    """Hand free memory back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function of batches that leaves no free memory with the idle worker when it is done."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return tidied


_HELD: dict[str, dict] = {}


def held(name: str) -> dict:
    """A table that a Python worker keeps between tasks of one operator. Asking for another operator's ('' for none) empties the rest, as idle workers keep their memory."""
    for other, table in _HELD.items():
        if other != name:
            table.clear()
    return _HELD.setdefault(name, {}) if name else {}


def _rng_table(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, n, dtype=U64, endpoint=False)


M_WORD = 0xD1342543DE82EF95


@functools.lru_cache(maxsize=8)
def _powers(m: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (m, pow(m, -1, 2**64)):
        a = np.full(size, base, U64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def powers(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """m**i and m**-i mod 2**64 for i from 0 to n at least."""
    size = 1 << max(16, (n + 1).bit_length())
    return _powers(m, size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Ranges:
    """Content hashes of any ranges of a 64-bit sequence, each from two prefix sums.

    For filing only: sums modulo 2**64 can be made to agree (long sequences of a regular build do), so no decision rests on them.
    """

    def __init__(self, values: np.ndarray, m: int):
        up, self.down = powers(m, len(values))
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(U64))


#: The first 0 to 8 bytes of a little-endian word.
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as a little-endian number; zeros follow the last."""
    return np.ndarray((len(data) + 1,), "<u8", data.tobytes() + bytes(8), strides=(1,))


def chained(wide: np.ndarray, start: np.ndarray, n: np.ndarray, seed: np.uint64) -> np.ndarray:
    """64-bit hashes of the strings of ``n`` bytes from ``start`` on: their blocks of eight bytes, mixed in one after the other.

    Two seeds give hashes that know nothing of each other.
    """
    h = mix(n.astype(U64) ^ seed)
    at, more = 0, np.flatnonzero(n > 0)
    if len(more) == len(n):
        h = mix(h ^ (wide[start] & FIRST_BYTES[np.minimum(n, 8)]))
        at, more = 8, np.flatnonzero(n > 8)
    while len(more):
        h[more] = mix(h[more] ^ (wide[start[more] + at] & FIRST_BYTES[np.minimum(n[more] - at, 8)]))
        at += 8
        more = more[n[more] > at]
    return h


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the ``n`` bytes from a on and those from b on are the same."""
    out, at, step = np.ones(len(a), bool), np.flatnonzero((a != b) & (n > 0)), 0
    while len(at):
        out[at] = data[a[at] + step] == data[b[at] + step]
        step += 1
        at = at[(n[at] > step) & out[at]]
    return out


def _lut(keep) -> np.ndarray:
    return np.array([bool(keep(i)) for i in range(256)])


#: Bytes of words: all but ASCII white space; letters a-z, digits and all that is not ASCII.
NOT_SPACE = _lut(lambda i: i != 0x20 and not 0x09 <= i <= 0x0D)
ALNUM = _lut(lambda i: not (i <= 0x2F or 0x3A <= i <= 0x60 or 0x7B <= i <= 0x7F))
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


#: Seeds of the two hashes of a word.
SEED, SEED2 = _rng_table(12, 2)


class Words:
    """The words of a slice of texts: starts and ends in ``data``, 64-bit hashes, ``off[i]:off[i+1]`` those of text i."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, keep: np.ndarray, lower: bool):
        self.data = data = LOWER[data] if lower else data
        n = len(data)
        inside = keep[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.off = np.searchsorted(self.starts, offs)
        self.wide = eights(data)
        self.hash = chained(self.wide, self.starts, self.ends - self.starts, SEED)

    def second(self) -> np.ndarray:
        """Another hash of each word, independent of the first."""
        return chained(self.wide, self.starts, self.ends - self.starts, SEED2)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, first byte of each word and one more): the words with one space after each."""
        n = self.ends - self.starts + 1
        at = np.concatenate([[0], np.cumsum(n)])
        out = self.data[np.minimum(np.repeat(self.starts - at[:-1], n) + np.arange(at[-1]), max(len(self.data) - 1, 0))]
        out[at[1:] - 1] = 0x20
        return out, at

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first 128 bits of the SHA-256 of words lo to hi, joined by single spaces, as two numbers a row."""
        out, at = self.joined()
        whole, sha = memoryview(np.ascontiguousarray(out)), hashlib.sha256
        ends = zip(at[lo].tolist(), np.maximum(at[hi] - 1, at[lo]).tolist())
        return np.frombuffer(b"".join([sha(whole[a:z]).digest()[:16] for a, z in ends]), "<u8").reshape(-1, 2)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES, table: str = ""):
    """(first row, rows after, bytes, offsets) of slices of whole texts, for the operator that holds ``table``."""
    held(table)
    data, offs = utf8(batch.column(batch.schema.get_field_index(text)))
    n, lo = batch.num_rows, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
