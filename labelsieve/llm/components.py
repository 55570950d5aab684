"""Connected components by alternating large and small stars; links never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.common import stored


def _stars(edges: DataFrame) -> bool:
    """Whether all edges hang nodes on the centres of stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0] is not True


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): of every node with a link, the smallest node it can reach.

    Each round hangs neighbours on the smallest node of a star, with grouped minima and equi-joins only, so a node with
    very many links is not gathered; rounds grow with the logarithm of the longest path, and links that are stars already
    take none, so an earlier result may stand for the links that it came from. Links from a node to itself and repeated
    links do no harm; no links give an empty result.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct()
        edges = stored(small, "links")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
