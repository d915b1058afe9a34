"""Streaming forms: reads to words and embeddings as they come, and running word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import embed, lsh


def words(reads: DataFrame, planes: lsh.Planes, keys: list[str], seq: str = "seq") -> DataFrame:
    """Hashed words of a stream of reads; stateless, so no watermark is needed."""
    return lsh.hash_reads(reads, planes, keys, seq)


def transform(reads: DataFrame, planes: lsh.Planes, model: DataFrame, keys: list[str], dim: int, seq: str = "seq") -> DataFrame:
    """Mean vectors of a stream of reads, with the model sent to executors (its size is checked)."""
    if model.count() * dim > embed.BROADCAST_FLOATS:
        raise ValueError("model too large to send to executors; use foreachBatch with mean_pool_joined")
    return embed.mean_pool_broadcast(words(reads, planes, keys, seq), model, keys, dim)


def transform_batches(reads: DataFrame, planes: lsh.Planes, model: DataFrame, keys: list[str], dim: int, sink, seq: str = "seq"):
    """The same for models of any size: each micro-batch is joined with the model and given to ``sink(df, epoch)``."""

    def step(batch: DataFrame, epoch: int) -> None:
        sink(embed.mean_pool_joined(words(batch, planes, keys, seq), model, keys, dim), epoch)

    return reads.writeStream.foreachBatch(step)


def word_counts(reads: DataFrame, planes: lsh.Planes, seq: str = "seq") -> DataFrame:
    """word, n so far (for output modes update and complete); state has a row for each word, 2**bits at most. Tasks count their batches first."""
    return lsh.word_counts(reads, planes, seq).groupBy("word").agg(F.sum("n").alias("n"))
