"""File forms of vectors, counts and embeddings; Parquet is the form to work with, these are for exchange."""

from __future__ import annotations

import gzip
import json
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.vec import to_text
from strandloom.operators.context import word_rank
from strandloom.storage import local

#: Bytes of a vector file that one task reads.
PART_BYTES = 64 << 20


def _open(path: str, mode: str):
    return gzip.open(path, mode) if path.endswith(".gz") else open(path, mode)


def _records(words: np.ndarray, values: np.ndarray, dim: int) -> np.ndarray:
    out = np.empty(len(words), np.dtype([("n", "<u8"), ("v", "<f4", (dim,))]))
    out["n"], out["v"] = dim, values.reshape(-1, dim)
    return out


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    words, lists = batch.column("word").to_numpy(zero_copy_only=False), batch.column("v")
    if lists.null_count or (lists.value_lengths().to_numpy(zero_copy_only=False) != dim).any():
        raise ValueError(f"a word has no vector of {dim} components")
    return words, lists.flatten().to_numpy(zero_copy_only=False).astype("<f4")


def save_vectors(vectors: DataFrame, path: str, vec: str = "wi", size: int | None = None, missing: DataFrame | None = None) -> int:
    """Vectors of the words 0 to ``size`` - 1 (by default to the greatest): u64 count, then for each u64 size and float32 values.

    Words that ``vectors`` lacks are taken from ``missing``; without it they end the job. Each task writes its words' records
    in their place of the file, so ``path`` is on a file system that executors share, and a task that runs again writes
    the same bytes. A .gz file cannot be written in parts: its rows come to the driver one partition at a time.
    """
    path = local(path)
    rows = vectors.select("word", F.col(vec).cast("array<float>").alias("v"))
    dim, top = rows.agg(F.max(F.size("v")), F.max("word")).first()
    dim, n = dim or 0, (0 if top is None else top + 1) if size is None else size
    if missing is not None:
        rows = rows.union(missing.join(rows, "word", "left_anti").select("word", F.col(vec).cast("array<float>").alias("v")))
    if rows.where(F.col("word").between(0, n - 1)).select("word").distinct().count() != n:
        raise ValueError(f"not all of the words 0 to {n - 1} have a vector")
    rows = rows.where(F.col("word") < n)
    if path.endswith(".gz"):
        with gzip.open(path, "wb") as f:
            f.write(struct.pack("<Q", n))
            for r in rows.orderBy("word").toLocalIterator():
                f.write(struct.pack("<Q", dim) + np.asarray(r.v, "<f4").tobytes())
        return n
    record = 8 + 4 * dim
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", n))
        f.truncate(8 + n * record)

    def write(batches):
        with open(path, "r+b") as f:
            for batch in batches:
                words, values = _matrix(batch, dim)
                out = _records(words, values, dim)
                cuts = [0, *(np.flatnonzero(np.diff(words) != 1) + 1).tolist(), len(words)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo < hi:
                        f.seek(8 + int(words[lo]) * record)
                        f.write(out[lo:hi].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([len(words)], pa.int64())], names=["n"])

    rows.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(write, "n long").agg(F.sum("n")).first()
    return n


def _stream(path: str, dim: int):
    """(first word, matrix) of a file whose records are read one after the other."""
    with _open(path, "rb") as f:
        (n,) = struct.unpack("<Q", f.read(8))
        for lo in range(0, n, 4096):
            rows = []
            for _ in range(min(4096, n - lo)):
                head = f.read(8)
                data = f.read(4 * struct.unpack("<Q", head)[0]) if len(head) == 8 else b""
                if len(data) != 4 * dim:
                    raise ValueError("vector file has a wrong size")
                rows.append(np.frombuffer(data, "<f4"))
            yield lo, np.array(rows, "<f4").reshape(-1, dim)
        if f.read(1):
            raise ValueError("vector file has a wrong size")


def _slices(path: str, dim: int, lo: int, hi: int):
    record = 8 + 4 * dim
    with open(path, "rb") as f:
        for at in range(lo, hi, 4096):
            f.seek(8 + at * record)
            rows = np.frombuffer(f.read((min(hi, at + 4096) - at) * record), np.dtype([("n", "<u8"), ("v", "<f4", (dim,))]))
            if (rows["n"] != dim).any():
                raise ValueError("vectors of one file have one size")
            yield at, rows["v"]


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, wi from a vector file on a file system that executors share. Tasks read ranges of records; a .gz file is read by one task."""
    path = local(path)
    with _open(path, "rb") as f:
        head = f.read(16)
    if len(head) < 8:
        raise ValueError("vector file has a wrong size")
    n = struct.unpack("<Q", head[:8])[0]
    dim = struct.unpack("<Q", head[8:])[0] if n and len(head) == 16 else 0
    whole = path.endswith(".gz")
    if not whole and os.path.getsize(path) != 8 + n * (8 + 4 * dim):
        raise ValueError("vector file has a wrong size")
    step = max(1, PART_BYTES // (8 + 4 * dim))
    parts = spark.range(0, 1 if whole else -(-n // step), 1, 1 if whole else max(1, -(-n // step)))

    def read(batches):
        for batch in batches:
            for part in batch.column("id").to_pylist():
                for at, m in _stream(path, dim) if whole else _slices(path, dim, part * step, min(n, (part + 1) * step)):
                    vec = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).ravel(), pa.float32()), dim).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(m))), vec], names=["word", "wi"])

    return parts.mapInArrow(read, "word long, wi array<float>")


def save_text_vectors(vectors: DataFrame, path: str, vec: str = "wi", zipped: bool = False) -> None:
    """A line for each word in order: components with six decimals, joined by spaces; text files in the folder ``path``."""
    vectors.orderBy("word").select(to_text(vec).alias("value")).write.text(path, compression="gzip" if zipped else "none")


def save_parts(model: DataFrame, folder: str, vocabulary: int, ranks: int, dim: int, zipped: bool = False) -> None:
    """For each rank of words the files part_r000000 (vectors) and part_r000000.wc.txt ("word count" with global words), in a shared folder; with ``zipped`` each ends in .gz.

    A rank's number of words comes first in its file and is counted before. A task writes a rank's files under names of their own
    and renames them when they are whole.
    """
    folder, end = local(folder), ".gz" if zipped else ""
    dealt = model.select("word", F.col("wi").cast("array<float>").alias("v"), "wc", word_rank("word", vocabulary, ranks).alias("rank"))
    sizes = {r.rank: r["count"] for r in dealt.groupBy("rank").count().collect()}

    def write(batches):
        part = {}
        for batch in batches:
            rank, (words, values), wc = batch.column("rank").to_numpy(), _matrix(batch, dim), batch.column("wc").to_pylist()
            for r in np.unique(rank).tolist():
                if r not in part:
                    base = f"{folder}/part_r{r:06d}"
                    own = f"{base}.{uuid.uuid4().hex}"
                    part[r] = [base, own, _open(own + end, "wb"), _open(f"{own}.wc.txt{end}", "wb")]
                    part[r][2].write(struct.pack("<Q", sizes[r]))
                at = np.flatnonzero(rank == r)
                part[r][2].write(_records(words[at], values.reshape(-1, dim)[at], dim).tobytes())
                part[r][3].write("".join(f"{words[i]} {wc[i]}\n" for i in at.tolist()).encode())
        for r, (base, own, f, counts) in part.items():
            f.close()
            counts.close()
            os.replace(own + end, base + end)
            os.replace(f"{own}.wc.txt{end}", f"{base}.wc.txt{end}")
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64())], names=["rank"])

    dealt.repartitionById(ranks, F.col("rank")).sortWithinPartitions("word").mapInArrow(write, "rank long").agg(F.count("*")).first()


def save_counts(counts: DataFrame, path: str) -> None:
    """Lines "word count" in order of words, as text files in the folder ``path``."""
    counts.orderBy("word").select(F.concat_ws(" ", "word", "n").alias("value")).write.text(path, compression="gzip" if path.endswith(".gz") else "none")


def load_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="word long, n long")


def save_embeddings(embedded: DataFrame, path: str, order: list[str], vec: str = "vec", zipped: bool = False) -> None:
    """A line for each read in input order: components with six decimals, joined by spaces."""
    embedded.orderBy(*order).select(to_text(vec).alias("value")).write.text(path, compression="gzip" if zipped else "none")


def save_model(model: DataFrame, path: str, **params) -> None:
    """A model table (word, wi, wo, wc) dealt out by word ranges, and its parameters."""
    model.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/model")
    model.sparkSession.createDataFrame([(json.dumps(params),)], "params string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/model"), json.loads(spark.read.text(f"{path}/params").first()[0])


def new_folder(path: str) -> str:
    """An output folder that must not exist yet."""
    if os.path.exists(path):
        raise FileExistsError(path)
    os.makedirs(path)
    return path
