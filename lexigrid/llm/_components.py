"""Connected components of a graph of any size: alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is joins and grouped minima over edge tables in the shared folder, so a hub costs no task more than its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import stored


def _is_forest(edges: DataFrame) -> bool:
    """Whether each node has one edge down, or edges up only: then every component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where(F.col("down") + F.col("up") > 1).isEmpty()


def star_forest(edges: DataFrame) -> DataFrame:
    """From pairs (u, v) of longs, the pairs (u, v) with v the smallest node of u's component and u any other node of it.

    Loops and repeated pairs are allowed; pairs holding a null are left out. No pairs: no rows.
    """
    now = stored(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_forest(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star")
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = stored(small.distinct(), "small")
    return now
