"""Connected components by alternating large and small stars; all of it joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import free, stored


def _lowest(pairs: DataFrame) -> DataFrame:
    """The smallest neighbour of each node u, itself included."""
    return stored(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")


def _large_star(edges: DataFrame) -> DataFrame:
    both = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    low = _lowest(both)
    # Both sides are stored tables, so a join partition with the edges of a hub can be split at run time.
    joined = both.join(low.hint("merge"), "u").where("v > u")
    large = stored(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
    free(both, low)
    return large


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    linked = down.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = stored(linked.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
    free(low)
    return small


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (u, v: long), component the smallest node reachable.

    Nodes without a link to another node are left out. Null ends and loops are no links. No links: no rows.
    The number of rounds grows with the logarithm of the longest path; only counts come to the driver.
    """
    edges = stored(links.select("u", "v").where("u <> v").distinct(), "links")
    before = _state(edges)
    while before[0]:
        large = _large_star(edges)
        small = _small_star(large)
        free(edges, large)
        edges = small
        after = _state(edges)
        if after == before:
            break
        before = after
    # The edges are stars now, from each node to its smallest.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
