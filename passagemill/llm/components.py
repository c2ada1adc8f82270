"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> labels(id, root): root is the smallest id of the component of id.

    Each round replaces every neighbourhood by a star around its smallest node, so that the number of
    rounds grows with the logarithm of the number of nodes, whatever the shape. Loops and repeated
    edges do no harm; ids without an edge have no row; an empty table gives an empty result.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = None
    while True:
        # large star: neighbours larger than u move to the smallest node that u sees, u included
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u itself, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u > v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
