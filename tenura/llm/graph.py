"""Connected components by alternating large and small stars, for links that are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import stored


#: A node with more than this share of the links is a hub: there are at most 2 / HUB_SHARE of those.
HUB_SHARE = 1 / 100


def _with_least(links: DataFrame, low: DataFrame, most: int) -> DataFrame:
    """links with their node's least neighbour m; the links of hubs stay where they are."""
    hubs = F.broadcast(low.filter(F.col("n") > most).select("u", "m"))
    rest = links.join(hubs.select("u"), "u", "left_anti").join(low.filter(F.col("n") <= most).select("u", "m"), "u")
    return links.join(hubs, "u").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def _large(edges: DataFrame, most: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.filter("v > u"), low, most).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(edges: DataFrame, most: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, low, most).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v), longs; the component is its least node.

    Each round is written to the shared folder; there are about as many rounds as
    the logarithm of the longest chain.
    """
    now = stored(edges.select("u", "v").filter("u != v").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        most = max(1, int(mark[0] * HUB_SHARE))
        now = stored(_small(stored(_large(now, most)), most))
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
