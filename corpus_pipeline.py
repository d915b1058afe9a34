"""A training-data pipeline: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. All but the last return the
columns of ``documents``. Between stages documents are written as Parquet to the folder that executors share.

Nulls: a null text is kept by all filters (it has no words, lines or shingles) and has no tokens; a null id matches no
label and no group. Rows that share an id are told apart: near-dedup keeps one of those with (nearly) one text. Columns other than those of
``documents`` go through the stages unchanged, whatever their names, and are left out by the last. An empty table gives
an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import boilerplate, bpe, common, decontaminate, nearjoin, ordinal

NEAR_WORDS, NEAR_PERCENT, BROADCAST_IDS = 5, 80, 300_000
#: What stages read; other columns get names of their own for the while, so that they cannot clash.
USED = ("doc_id", "text", "source")


def shield(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with columns that stages don't read renamed, and the expressions that bring back names and order."""
    common.small_batches(docs.sparkSession)
    names = {c: c if c in USED else f"_x{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` set to the text's length, if there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ordinal.fit(docs, common.documents(spark, sf_dir, "labels"))
    plain, back = shield(docs)
    return ordinal.score(plain, model, keep=tuple(plain.columns)).where(F.col("p_toxic") < ordinal.REJECT_AT).select(*back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, back = shield(docs)
    return counted(boilerplate.drop_boilerplate(plain).select(*back))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = docs, "doc_id"
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("`count` > 1").isEmpty():
        # Rows that share an id are told apart by a number in the order of ids.
        plain, back = shield(docs)
        rows, key = plain.orderBy("doc_id", "text").withColumn("_k", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())).checkpoint(), "_k"
    found = nearjoin.near_duplicates(rows, k=NEAR_WORDS, percent=NEAR_PERCENT, doc_id=key)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).checkpoint()
    few = gone.count() <= BROADCAST_IDS
    left = rows.join(F.broadcast(gone) if few else gone, rows[key] == gone["_gone"], "left_anti")
    return left if key == "doc_id" else left.select(*back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, back = shield(docs)
    found = decontaminate.find(plain, common.documents(spark, sf_dir, "benchmark"), keep=tuple(plain.columns), nulls=True)
    return found.where(F.size("hit_spans") == 0).select(*back)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, tokens."""
    found = bpe.encode(docs, *bpe.public())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.col("ids").alias("tokens"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_tokens", tokens),
]

#: SQL cannot express the fitted model and the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
