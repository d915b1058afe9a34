"""Context windows, training pairs, word counts, negatives, keyed shuffles and chunks.

The window of word i is asymmetric: hw words to the left, hw - 1 to the right, without word i. Words of all gap-free
segments of a read stand in one array, so windows cross gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contexts(words: DataFrame, half_window: int, keys: list[str], array: str = "words", symmetric: bool = False) -> DataFrame:
    """``keys``, pos, center, context: one row for each word, also where the context is empty. No shuffle."""
    if half_window < 1:
        raise ValueError("half_window is 1 or more")
    right = half_window if symmetric else half_window - 1
    pos = F.col("pos")
    left = F.slice(array, F.greatest(pos - half_window, F.lit(0)) + 1, F.least(pos, F.lit(half_window)))
    after = F.slice(array, pos + 2, F.lit(right)) if right else F.slice(array, F.lit(1), F.lit(0))
    return words.select(*keys, array, F.posexplode(array).alias("pos", "center")).select(*keys, "pos", "center", F.concat(left, after).alias("context"))


def contexts_windowed(rows: DataFrame, half_window: int, keys: list[str], word: str = "word") -> DataFrame:
    """The same from one row for each word (keys, pos, word), by window frames."""
    w = Window.partitionBy(*keys).orderBy("pos")
    left = F.collect_list(word).over(w.rowsBetween(-half_window, -1))
    context = left if half_window == 1 else F.concat(left, F.collect_list(word).over(w.rowsBetween(1, half_window - 1)))
    return rows.select(*keys, "pos", F.col(word).alias("center"), context.alias("context"))


def skipgram_pairs(words: DataFrame, half_window: int, keys: list[str], array: str = "words") -> DataFrame:
    """``keys``, pos, center (the label), context (the single input)."""
    return contexts(words, half_window, keys, array).select(*keys, "pos", "center", F.explode("context").alias("context"))


def word_counts(words: DataFrame, half_window: int, keys: list[str], array: str = "words", skipgram: bool = False) -> DataFrame:
    """word, n: how often a word is trained as a label: once for each non-empty context, or with ``skipgram`` for each pair."""
    own = contexts(words, half_window, keys, array).select(F.col("center").alias("word"), F.size("context").alias("c")).where("c > 0")
    return own.groupBy("word").agg((F.sum("c") if skipgram else F.count("*")).cast("long").alias("n"))


def dense_counts(counts: DataFrame, bits: int) -> DataFrame:
    """word, n for each of the 2**bits words, zeros included."""
    every = counts.sparkSession.range(1 << bits).withColumnRenamed("id", "word")
    return every.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def top_words(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "word").limit(n)


def negatives(target, vocabulary: int, n: int, *draw, seed: int = 0) -> Column:
    """n words other than ``target``, each alike likely; ``draw`` are columns that tell rows apart. Always the same for the same rows."""
    if vocabulary < 2:
        raise ValueError("negatives need two words or more")
    target = F.col(target) if isinstance(target, str) else target
    picks = [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *draw), F.lit(vocabulary - 1)) for i in range(n)]
    return F.array(*(p + F.when(p >= target, 1).otherwise(0) for p in picks))


def negatives_lcg(target, vocabulary: int, n: int, draw) -> Column:
    """The same with a linear congruence of one number, which any SQL engine computes alike."""
    if vocabulary < 2:
        raise ValueError("negatives need two words or more")
    target, draw = (F.col(x) if isinstance(x, str) else x for x in (target, draw))
    picks = [F.pmod((draw * 1103515245 + 12345 * (i + 1)) % 2147483648, F.lit(vocabulary - 1)) for i in range(n)]
    return F.array(*(p + F.when(p >= target, 1).otherwise(0) for p in picks))


def negatives_keyed(target, vocabulary: int, n: int, *draw, seed: int = 0) -> Column:
    """The same by ``order_key``: alike likely, and the same in SQL."""
    if vocabulary < 2:
        raise ValueError("negatives need two words or more")
    target = F.col(target) if isinstance(target, str) else target
    picks = [F.pmod(order_key(*draw, F.lit(i), seed=seed), F.lit(vocabulary - 1)) for i in range(n)]
    return F.array(*(p + F.when(p >= target, 1).otherwise(0) for p in picks))


def order_key(*ids, seed: int = 0, epoch: int = 0) -> Column:
    """A number of 60 bits from the MD5 sum of seed, epoch and ids: the same on each retry, on each machine and in SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), *(F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids))), 1, 15), 16, 10).cast("long")


def shuffled_batches(rows: DataFrame, number: str, size: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``rows`` with ``batch`` and ``place``: batches of ``size`` by ``number``, each in an order of its own by epoch. A window holds one batch."""
    if size < 1:
        raise ValueError("size is 1 or more")
    own = rows.withColumn("batch", F.floor(F.col(number) / size)).withColumn("_order", order_key(number, seed=seed, epoch=epoch))
    place = F.row_number().over(Window.partitionBy("batch").orderBy("_order", number)) - 1
    return own.withColumn("place", place).drop("_order")


def shuffled(rows: DataFrame, seed: int, whole: bool = False) -> DataFrame:
    """Rows in random order: within partitions (no shuffle of data), or with ``whole`` among all. Where an order must outlive a lost executor, take one by key."""
    return rows.orderBy(F.rand(seed)) if whole else rows.withColumn("_r", F.rand(seed)).sortWithinPartitions("_r").drop("_r")


def keyed_order(rows: DataFrame, number: str, seed: int = 0, epoch: int = 0, size: int = 0) -> DataFrame:
    """Rows in the keyed order of ``number``, within partitions (no shuffle of data); with ``size`` in batches of so many numbers that follow each other."""
    batch = [F.floor(F.col(number) / size)] if size else []
    return rows.sortWithinPartitions(*batch, order_key(number, seed=seed, epoch=epoch), number)


def chunks(array, size: int) -> Column:
    """Parts of ``size`` elements; the last may be shorter."""
    array = F.col(array) if isinstance(array, str) else array
    at = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(array, i, F.lit(size)))


def word_rank(word, vocabulary: int, ranks: int) -> Column:
    """Rank that owns a word when words are dealt out in ranges; the last range takes what is left."""
    word = F.col(word) if isinstance(word, str) else word
    size = max(1, vocabulary // ranks + (vocabulary % ranks > ranks // 2))
    return F.least(F.floor(word / size), F.lit(ranks - 1)).cast("int")


def by_range(model: DataFrame, ranks: int) -> DataFrame:
    """A model table dealt out by word ranges."""
    return model.repartitionByRange(ranks, "word")
