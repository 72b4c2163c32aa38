"""Connected components of links, as rounds of joins and small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.llm.shared import stored


def _settled(edges: DataFrame) -> bool:
    """Every node points at one other, and that one at none."""
    twice = edges.groupBy("u").count().where("count > 1").select("u")
    inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return twice.unionByName(inner).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), the component being its smallest node.

    Alternating stars: every node points its larger neighbours, then its smaller ones, at the smallest it knows of.
    A round writes no more links than it read; the number of rounds grows with the logarithm of the longest path.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stored(pairs.distinct(), "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-stars")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "small-stars")
    reached = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return reached.unionByName(roots)
