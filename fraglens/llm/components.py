"""Connected components of a link table, with all state in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node of a link.

    Alternating large-star and small-star: each round moves a node's larger
    neighbours to its smallest one, then its smaller neighbours. A star's hub is
    a key only on the side that is reduced to a minimum (map-side combined) or
    split by the skew join. Ends when a round changes nothing; the number of
    rounds grows with the logarithm of the longest chain.
    """
    edges = cut(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct())
    seen = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        # Large star: neighbours above u go to the least of u and its neighbours.
        large = both.filter("v > u").join(low, "u").select(F.col("low").alias("u"), "v").filter("u < v").distinct()
        # Small star: neighbours below v, and v itself, go to the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(least, "v")
        edges = cut(small.select("low", "v").unionByName(small.select("low", F.col("u").alias("v"))).filter("low < v").distinct().select(F.col("low").alias("u"), "v"))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    hubs = edges.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(hubs)
