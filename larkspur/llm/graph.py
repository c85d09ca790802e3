"""Connected components by alternating large-star and small-star steps, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch


def stars(edges: DataFrame) -> bool:
    """Whether each node of the edges (u, v) has one v at most, and none is both u and v."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the component's smallest node.

    Each round is written to shared storage, so lineage stays short and lost executors cost one
    round. Both steps join a node's edges with its smallest neighbour; where a node has very many
    edges, adaptive execution splits that join. Loops and repeated edges are dropped; nulls must not
    occur. Rounds grow with the logarithm of a component's size.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(star).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = scratch.keep(small, "edges")
        scratch.drop(now)
        now = nxt
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
