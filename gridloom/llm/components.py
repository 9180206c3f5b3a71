"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for nodes with links (u, v); the label is the component's least node.

    Every step groups with map-side minima and joins on nodes, so a node with very many links is
    split by adaptive execution; each step is written to the shared folder. Steps end once the links
    are stars: every node has one lesser neighbour, which has none itself. Links of a node to
    itself are ignored, repeated ones do no harm. Labels (node, label) of earlier links are links too, so more
    links are added to them rather than to what they came from.
    """
    edges = links.select("u", "v").where("u <> v")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stage(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        if stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def stars(edges: DataFrame) -> bool:
    """Whether distinct links (u, v), v below u, are stars: no node has two lesser neighbours, or both lesser and greater ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").head(1)
