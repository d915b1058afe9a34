"""Counts of k-mers by tasks: letters of Arrow batches become numbers, and a task sends on what it counted.

A k-mer's number has two bits for each letter (A 0, C 1, G 2, T 3, first letter highest), so numbers of k-mers stand in the
order of their letters and the lesser of two is the canonical one. Letters other than A, C, G and T part k-mers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.seq import MAX_CODE_K
from strandloom.operators import lsh

_CODE = np.full(256, 4, np.int64)
_CODE[[ord(c) for c in "ACGT"]] = range(4)
#: Up to so many possible k-mers a task counts in one array.
DENSE = 1 << 16


def numbers(data: np.ndarray, offs: np.ndarray, k: int, canonical: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, read of each) of all k-mers of many reads, given as bytes and offsets."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = _CODE[data]
    read = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    bad = np.concatenate([[0], np.cumsum(code == 4)])
    ok = (bad[k:] == bad[:-k]) & (read[:n] == read[k - 1 :])
    out, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for p in range(k):
        out <<= 2
        out += code[p : p + n]
        if canonical:
            back += (3 - code[p : p + n]) << (2 * p)
    if canonical:
        out = np.minimum(out, back)
    return out[ok], read[:n][ok]


def _pieces(column: pa.Array, k: int):
    """(first read, bytes, offsets) of about ``lsh.SLICE_BYTES`` letters; longer reads in pieces that share k - 1 letters."""
    data, offs = lsh._bytes_of(column)
    for lo, hi in lsh._slices(offs):
        for at in range(offs[lo], max(offs[hi], offs[lo] + 1), lsh.SLICE_BYTES) if hi == lo + 1 else [offs[lo]]:
            end = min(offs[hi], at + lsh.SLICE_BYTES + k - 1) if hi == lo + 1 else offs[hi]
            yield lo, data[at:end], np.array([0, end - at]) if hi == lo + 1 else offs[lo : hi + 1] - offs[lo]


def letter_batches(old: str, new: str):
    """What makes Arrow batches whose last column are texts such with reads in its place: each letter of ``old`` as that of ``new`` in its
    place, without all else; null is empty. Both are ASCII. Slices of about ``lsh.SLICE_BYTES`` are done one by one."""
    table = np.zeros(256, np.uint8)
    table[list(old.encode("ascii"))] = list(new.encode("ascii"))

    def run(batches):
        for batch in batches:
            names = [*batch.schema.names[:-1], "seq"]
            data, offs = lsh._bytes_of(batch.column(batch.num_columns - 1))
            for lo, hi in lsh._slices(offs):
                own = table[data[offs[lo] : offs[hi]]]
                kept = own != 0
                ends = np.cumsum([0, *(np.count_nonzero(kept[a:z]) for a, z in zip(offs[lo:hi] - offs[lo], offs[lo + 1 : hi + 1] - offs[lo]))])
                seq = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(own[kept])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), seq], names=names)

    return run


def lettered(texts: DataFrame, keys: list[str], text: str, old: str, new: str) -> DataFrame:
    """``keys`` and seq: texts as ``letter_batches`` makes them."""
    src = texts.select(*keys, F.col(text).alias("_text"))
    schema = src.drop("_text").withColumn("seq", F.lit("").cast("string")).schema
    return src.mapInArrow(letter_batches(old, new), schema)


def _check(k: int) -> None:
    if not 1 <= k <= MAX_CODE_K:
        raise ValueError(f"k is 1 to {MAX_CODE_K}")


def letters(number, k: int) -> Column:
    """The k-mer of a number."""
    number = F.col(number) if isinstance(number, str) else number
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def counts(reads: DataFrame, k: int, canonical: bool = True, seq: str = "seq") -> DataFrame:
    """kmer, n of all reads. A task sends a row for each k-mer it saw (of many possible k-mers, for each piece of reads)."""
    _check(k)

    def rows(words, n):
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], names=["number", "n"])

    def run(batches):
        held = np.zeros(4**k, np.int64) if 4**k <= DENSE else None
        for batch in batches:
            for _, data, offs in _pieces(batch.column(0), k):
                own = numbers(data, offs, k, canonical)[0]
                if held is not None:
                    held += np.bincount(own, minlength=len(held))
                else:
                    yield rows(*np.unique(own, return_counts=True))
        if held is not None:
            at = np.flatnonzero(held)
            yield rows(at, held[at])

    found = reads.select(seq).mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    return found.select(letters("number", k).alias("kmer"), "n")


def distinct_counts(reads: DataFrame, k: int, keys: list[str], canonical: bool = True, seq: str = "seq") -> DataFrame:
    """``keys`` and n, the different k-mers of each read that has any. No shuffle."""
    _check(k)
    src = reads.select(*keys, F.col(seq).alias("_seq"))
    schema = src.drop("_seq").withColumn("n", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            n, long = np.zeros(batch.num_rows, np.int64), {}
            for lo, data, offs in _pieces(batch.column(batch.num_columns - 1), k):
                own, read = numbers(data, offs, k, canonical)
                if len(offs) == 2:
                    long[lo] = np.union1d(long[lo], own) if lo in long else np.unique(own)
                elif (len(offs) - 1) * 4**k <= 8 * lsh.SLICE_BYTES:
                    seen = np.zeros((len(offs) - 1, 4**k), bool)
                    seen[read, own] = True
                    n[lo : lo + len(seen)] = seen.sum(1)
                else:
                    order = np.lexsort((own, read))
                    own, read = own[order], read[order]
                    new = np.ones(len(own), bool)
                    new[1:] = (own[1:] != own[:-1]) | (read[1:] != read[:-1])
                    n[lo : lo + len(offs) - 1] = np.bincount(read[new], minlength=len(offs) - 1)
            for at, own in long.items():
                n[at] = len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[*keys, "n"])

    return src.mapInArrow(run, schema).where("n > 0")
