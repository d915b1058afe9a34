"""Sharding by a k-d tree over metadata, with DataFrame operations only.

The root holds all rows and all shards. A node with k shards is cut along its widest dimension (relative to the root's
width) where the rows on the left weigh floor(k/2)/k of it, until each leaf is one shard. Dimensions are the logarithm
of the size, hashes of the categorical columns, and the id; along each, rows are ordered by its value and then by a hash
of the id, so a cut can pass through rows of one value. A weighted median is found from sums over at most ``BINS`` bins
a node, again within the bin it falls in, until that bin weighs no more than the largest row. Sums, running sums and the
choice of cuts are all DataFrame operations, with one row a node, and rows with their nodes are stored after each level:
what comes to the driver is a few numbers, whatever the input and the number of shards.

Law 'bytes': sizes of shards differ by a few of the largest rows. Size is the text's UTF-8 bytes plus 8; a null text has
none. Null metadata count as a value of their own; repeated ids fall together and are numbered in order of size and
checksum; an empty table gives an empty result. Equal texts may part. Slots are gapless from 0 in each shard: rows are
numbered in hash buckets of about ``BUCKET_ROWS`` rows, so no task has to hold a whole shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.storage import checkpoint_dir

from .common import counted, documents, stored

BINS, BUCKET_ROWS, BROADCAST_NODES = 1024, 100_000, 100_000
_HIGH, _LOW = (1 << 31) - 1, 1 << 31


def shards_for(total_bytes: int, target_bytes: int) -> int:
    """Number of leaves of at most ``target_bytes`` on average."""
    return max(1, -(-total_bytes // target_bytes))


def keyed(rows: DataFrame, dims: list[str], doc_id: str = "doc_id") -> DataFrame:
    """``rows`` with ``_k``, their places along ``dims``: the value, scaled to the table's width (null comes first), then a hash of the id."""
    ends = rows.agg(F.count("*").alias("n"), *(f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(dims) for n, f in (("a", F.min), ("z", F.max)))).first()
    low = F.xxhash64(doc_id).bitwiseAND(F.lit(_LOW - 1))
    keys = []
    for i, c in enumerate(dims):
        a, z = ends[f"a{i}"] or 0.0, ends[f"z{i}"] or 0.0
        part = F.coalesce((F.col(c).cast("double") - a) / (z - a) * (_HIGH - 1) + 1, F.lit(0.0)) if z > a else F.lit(0.0)
        keys.append(F.floor(part).cast("long") * _LOW + low)
    return rows.select("*", F.array(*keys).alias("_k"))


def _few(table: DataFrame, n: int) -> DataFrame:
    """A stored table of one row for each of ``n`` nodes, sent to all tasks if it is small."""
    return F.broadcast(table) if n <= BROADCAST_NODES else table


def _cuts(tree: DataFrame, n_dims: int, size: str, bins: int) -> tuple[DataFrame, int]:
    """((_n, _d, _at): of each node with several shards, along which dimension it is cut and where; number of these nodes). Nodes left to cut are counted while cuts are stored."""
    open_ = tree.where("_s > 1")
    stats = open_.groupBy("_n", "_s").agg(F.sum(size).alias("_w"), F.max(size).alias("_top"), *(f(F.col("_k")[i]).alias(f"{n}{i}") for i in range(n_dims) for n, f in (("_a", F.min), ("_z", F.max))))
    widest = F.array_max(F.array(*(F.struct((F.col(f"_z{i}") - F.col(f"_a{i}")).alias("width"), F.lit(-i).alias("d"), F.col(f"_a{i}").alias("lo"), (F.col(f"_z{i}") + 1).alias("hi")) for i in range(n_dims))))
    want = F.col("_w") * F.floor(F.col("_s") / 2) / F.col("_s")
    left = {"left": F.col("_at").isNull().cast("long")}
    cuts, seen = counted(stats.withColumn("_x", widest).select("_n", (-F.col("_x.d")).alias("_d"), F.col("_x.lo").alias("_lo"), F.col("_x.hi").alias("_hi"), F.lit(0).cast("long").alias("_seen"), want.alias("_want"), "_top", F.lit(None).cast("long").alias("_at")), **left)
    while n := seen["left"]:
        step = cuts.where("_at IS NULL").withColumn("_step", F.expr(f"(_hi - _lo + {bins - 1}) div {bins}"))
        at = F.col("_k")[F.col("_d")]
        sums = open_.join(_few(step, n), "_n").where((at >= F.col("_lo")) & (at < F.col("_hi"))).groupBy("_n", F.expr("(_k[_d] - _lo) div _step").alias("_b")).agg(F.sum(size).alias("_sum"))
        upto = F.sum("_sum").over(Window.partitionBy("_n").orderBy("_b")) + F.col("_seen")
        found = sums.join(_few(step, n), "_n").withColumn("_upto", upto).where("_upto >= _want AND _upto - _sum < _want")
        lo = F.col("_lo") + F.col("_b") * F.col("_step")
        # Rows under the cut go left; the bin goes where the cut comes closer to what is wanted.
        near = F.when(F.col("_upto") - F.col("_want") <= F.col("_want") - (F.col("_upto") - F.col("_sum")), lo + F.col("_step")).otherwise(lo)
        done = F.when((F.col("_step") == 1) | (F.col("_sum") <= F.col("_top")), near)
        found = found.select("_n", "_d", lo.alias("_lo"), F.least("_hi", lo + F.col("_step")).alias("_hi"), (F.col("_upto") - F.col("_sum")).alias("_seen"), "_want", "_top", done.alias("_at"))
        cuts, seen = counted(found.union(cuts.where("_at IS NOT NULL")), **left)
    return cuts.select("_n", "_d", "_at"), seen["rows"]


def assign(rows: DataFrame, n_shards: int, dims: list[str], size: str = "size", doc_id: str = "doc_id", bins: int = BINS) -> DataFrame:
    """``rows`` with an int column ``shard``. ``dims`` are numeric columns; ``rows`` is read several times, so it should be stored. Sizes are above 0."""
    # A node is named by its first shard and has _s of them.
    tree = keyed(rows, dims, doc_id).select("*", F.lit(0).alias("_n"), F.lit(n_shards).alias("_s"))
    for _ in range((n_shards - 1).bit_length()):
        cuts, n = _cuts(tree, len(dims), size, bins)
        left, cut = F.floor(F.col("_s") / 2).cast("int"), F.col("_at").isNotNull()
        right = cut & (F.col("_k")[F.col("_d")] >= F.col("_at"))
        tree = stored(
            tree.join(_few(cuts, n), "_n", "left").select(
                *rows.columns, "_k", F.when(right, F.col("_n") + left).otherwise(F.col("_n")).alias("_n"), F.when(right, F.col("_s") - left).when(cut, left).otherwise(F.col("_s")).alias("_s")
            )
        )
    return tree.select(*rows.columns, F.col("_n").alias("shard"))


def numbered(rows: DataFrame, order: list[str], n_rows: int, doc_id: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each ``shard``."""
    buckets = max(1, n_rows // bucket_rows)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(doc_id), F.lit(buckets)))
    counts = rows.groupBy("shard", "_b").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_o", F.sum("_c").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_c")).drop("_c")
    own = F.row_number().over(Window.partitionBy("shard", "_b").orderBy(*order))
    return rows.withColumn("_r", own).join(before, ["shard", "_b"]).withColumn("slot", (F.col("_o") + F.col("_r") - 1).cast("long")).drop("_b", "_r", "_o")


def shard(docs: DataFrame, n_shards: int | None = None, target_bytes: int = 512 << 20, categories=("source", "lang"), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row; without ``n_shards``, leaves have about ``target_bytes``."""
    checkpoint_dir(docs.sparkSession)
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        *(F.crc32(F.col(c).cast("string").cast("binary")).alias(f"_c{i}") for i, c in enumerate(categories)),
    ).checkpoint()
    slim = slim.withColumn("_log", F.log2("size"))
    n_rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    placed = assign(slim, n_shards or shards_for(total, target_bytes), ["_log", *(f"_c{i}" for i in range(len(categories))), "doc_id"])
    out = numbered(placed, ["doc_id", "size", "text_crc32"], n_rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7(spark, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), 24)
