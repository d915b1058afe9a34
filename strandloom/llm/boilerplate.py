"""Line dedup by site-relative frequency.

Of each host, the pages that hold a line are divided by the host's pages; lines above ``ratio`` (and on ``min_pages``
pages at least) are boilerplate and go from all of the host's pages. Lines are parted by line ends and compared as they
are, by 64-bit hashes within a host; blank lines are neither counted nor dropped.

A line exactly at the ratio stays; equal lines go or stay together on all pages of a host. An empty table gives an empty
result. A null host is the host ''; a null text stays null and counts as a page without lines; repeated rows are pages of their
own; a host of fewer than ``min_pages`` pages loses nothing; columns of the input are kept,
whatever their names (but those named like the two counts are left out).

A host has fewer boilerplate lines than (lines on its mean page) / ``ratio``, since each is on that share of its pages.
So a host's boilerplate fits in one row. Those rows are broadcast up to ``broadcast_lines`` lines in all, which is
checked first; beyond, hosts are joined by shuffle, where Spark splits skewed hosts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.storage import checkpoint_dir

from .common import documents

RATIO, MIN_PAGES, BROADCAST_LINES = 0.05, 5, 500_000


def _lines(text):
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_host, _dropped: hashes of the host's boilerplate lines); hosts without any are left out."""
    of = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col(text).alias("_text"))
    held = of.select("_host", F.explode(F.array_distinct(F.transform(F.filter(_lines("_text"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))).alias("_line"))
    counts = held.groupBy("_host", "_line").agg(F.count("*").alias("_on")).where(F.col("_on") >= min_pages)
    totals = of.groupBy("_host").agg(F.count("*").alias("_pages"))
    often = counts.join(totals, "_host").where(F.col("_on") > ratio * F.col("_pages"))
    return often.groupBy("_host").agg(F.collect_list("_line").alias("_dropped"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``pages`` with ``text`` freed of boilerplate, and the columns _n_lines and _n_dropped after its own."""
    checkpoint_dir(pages.sparkSession)
    found = boilerplate(pages, host, text, ratio, min_pages).checkpoint()
    lines = found.agg(F.coalesce(F.sum(F.size("_dropped")), F.lit(0))).first()[0]
    # The row travels as one column, so that its names cannot clash with those used here.
    columns = [c for c in pages.columns if c not in ("_n_lines", "_n_dropped")]
    keyed = pages.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), _lines(F.col(text)).alias("_all"))
    joined = keyed.join(F.broadcast(found) if lines <= broadcast_lines else found, "_host", "left")
    kept = F.filter("_all", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_dropped"), F.xxhash64(x)))
    out = joined.withColumn("_kept", F.when(F.col("_dropped").isNull(), F.col("_all")).otherwise(kept))
    field = lambda c: F.array_join("_kept", "\n").alias(c) if c == text else F.col("_row").getField(c).alias(c)
    count = lambda c: F.when(c.isNull(), 0).otherwise(c).cast("long")
    n_lines = F.when(F.col("_all").isNotNull(), F.size("_all"))
    return out.select(*map(field, columns), count(n_lines).alias("_n_lines"), count(n_lines - F.size("_kept")).alias("_n_dropped"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return drop_boilerplate(docs).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, string_split(text, chr(10)) AS ls FROM documents),
tot AS (SELECT host, count(*) AS pages FROM d GROUP BY 1),
seen AS (SELECT DISTINCT r, host, line FROM (SELECT r, host, unnest(ls) AS line FROM d) WHERE trim(line, ' ') <> ''),
bad AS (SELECT host, list(line) AS lines FROM (SELECT host, line, count(*) AS n FROM seen GROUP BY 1, 2 HAVING count(*) >= {MIN_PAGES}) JOIN tot USING (host) WHERE n > {RATIO} * pages GROUP BY 1),
kept AS (SELECT doc_id, ls, list_filter(ls, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(lines, []), x)) AS ks FROM d LEFT JOIN bad USING (host))
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(ks), 0)::BIGINT AS n_dropped, sha256(coalesce(array_to_string(ks, chr(10)), '')) AS kept_sha256 FROM kept
"""
