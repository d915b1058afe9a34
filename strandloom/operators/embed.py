"""Embedding lookup and mean pooling of reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import vec as V

#: Floats of a model that may be broadcast (4 bytes each).
BROADCAST_FLOATS = 64 << 20


def lookup(rows: DataFrame, model: DataFrame, word: str = "word", vec: str = "wi", check: bool = True) -> DataFrame:
    """``rows`` with the vector of their word. With ``check``, a word that the model lacks ends the query."""
    held = model.select(F.col("word").alias(word), F.col(vec).alias("vec"))
    out = rows.join(held, word, "left")
    lost = F.raise_error(F.concat(F.lit("no vector for word "), F.col(word).cast("string")))
    return out.withColumn("vec", F.coalesce("vec", lost.cast("array<float>"))) if check else out


def missing_words(rows: DataFrame, model: DataFrame, word: str = "word") -> DataFrame:
    return rows.select(word).distinct().join(model.select(F.col("word").alias(word)), word, "left_anti")


def mean_pool_joined(reads: DataFrame, model: DataFrame, keys: list[str], dim: int, words: str = "words", check: bool = False) -> DataFrame:
    """``keys`` and ``vec``, the mean vector of a read's words (repeats count each), zeros for a read without words.

    Words are counted by read before vectors are joined.
    """
    counted = reads.select(*keys, F.explode(words).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("c"))
    held = lookup(counted, model, check=check)
    means = V.mean_by(held, keys, "vec", "_v", weight="c", dim=dim)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return reads.select(*keys).alias("l").join(means.alias("r"), same, "left").select(*(F.col(f"l.{k}") for k in keys), F.coalesce("r._v", V.zeros(dim)).alias("vec"))


def mean_pool_broadcast(reads: DataFrame, model: DataFrame, keys: list[str], dim: int, words: str = "words") -> DataFrame:
    """The same with the model sent to executors, in one narrow step, after a check of its size. Words that the model lacks don't count."""
    if model.count() * dim > BROADCAST_FLOATS:
        raise ValueError(f"a model of more than {BROADCAST_FLOATS} floats is not sent to executors; use mean_pool_joined")
    rows = model.select("word", "wi").toArrow()
    word = rows.column("word").to_numpy()
    matrix = rows.column("wi").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)
    order = np.argsort(word)
    shared = reads.sparkSession.sparkContext.broadcast((word[order], matrix[order]))
    src = reads.select(*keys, F.col(words).alias("_words"))
    schema = src.drop("_words").withColumn("vec", F.array().cast("array<double>")).schema

    def run(batches):
        known, vectors = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                lists = part.column(part.schema.get_field_index("_words"))
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int))
                out = np.zeros((len(lists), dim))
                if len(flat) and len(known):
                    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    ok = known[at] == flat
                    n = np.bincount(row[ok], minlength=len(lists))
                    first = np.searchsorted(row[ok], np.flatnonzero(n))
                    if len(first):
                        out[n > 0] = np.add.reduceat(vectors[at[ok]], first, axis=0) / n[n > 0, None]
                vec = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dim).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keys] + [vec], names=[*keys, "vec"])

    return src.mapInArrow(run, schema)


def mean_pool(reads: DataFrame, model: DataFrame, keys: list[str], dim: int, words: str = "words") -> DataFrame:
    """By broadcast where the model's size, checked first, allows it, else by join."""
    return mean_pool_broadcast(reads, model, keys, dim, words) if model.count() * dim <= BROADCAST_FLOATS else mean_pool_joined(reads, model, keys, dim, words)
