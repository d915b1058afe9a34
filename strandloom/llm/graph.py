"""Connected components of undirected edges, by contraction with DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, release, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component: the smallest id reachable) for each id in the columns a, b of ``edges``.

    Each round gives every node the smallest of itself and its neighbours, follows these labels to their ends by doubling
    (a chain of n labels takes log n steps), puts them in place of the ends of edges, and drops edges that became loops;
    the graph shrinks until none is left. Hubs are summed up before the shuffle, and their joins are ones that Spark can
    split. Nulls are left out; no edges give an empty result.
    """
    kind = "a long, b long"
    now, left = counted(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), kind)
    out = None
    while out is None or left["rows"]:
        both = now.union(now.select("b", "a"))
        low = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("m")), "id long, m long")
        while True:
            ends = low.select(F.col("id").alias("m"), F.col("m").alias("e"))
            jumped, seen = counted(low.join(ends, "m").select("id", "m", "e"), "id long, m long, e long", moved=(F.col("m") != F.col("e")).cast("long"))
            low = jumped.select("id", F.col("e").alias("m"))
            if not seen["moved"]:
                break
        if out is None:
            out = low.select("id", F.col("m").alias("component"))
        else:
            moved = out.join(low.select(F.col("id").alias("component"), "m"), "component", "left")
            out = stored(moved.select("id", F.coalesce("m", "component").alias("component")), "id long, component long")
        a, b = low.select(F.col("id").alias("a"), F.col("m").alias("_a")), low.select(F.col("id").alias("b"), F.col("m").alias("_b"))
        rest = now.join(a, "a").join(b, "b").where("_a <> _b")
        now, left = counted(rest.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), kind)
    release(out.sparkSession)
    return out
