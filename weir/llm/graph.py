"""Connected components of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def unfinished(edges: DataFrame) -> bool:
    """Whether some node has several of the edges, each from u to a lesser v, or is the end of one and the start of another."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("x")).select("x.*")
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return nodes.where("out > 1 or (out = 1 and least = 0)").count() > 0


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) of all nodes in links (columns a, b; loops and repeats are harmless).

    Each step is grouping and joining by node; a node of very many links is only ever summed or joined, which adaptive
    execution splits. Edges are written out after each pair of steps, of which there are few: every step at least
    halves the paths of a tree. Steps end once each node has one edge, to a least node; links that are so at first take none.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(links.select(b.alias("u"), a.alias("v")).where("u <> v").distinct(), "edges")
    while unfinished(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
