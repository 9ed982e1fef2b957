"""Connected components by alternating large-star and small-star steps, each a min over neighbours and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, settled


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links each node's neighbours (above it; or, ``small``, up to it) to the least of them and itself.

    The least neighbours are settled first, so the join has two plain shuffles and adaptive execution can split a hub's rows.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.where("b < a") if small else both
    least = settled(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "edges-least")
    near = near if small else near.where("b > a")
    moved = near.join(least, near["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if small:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = settled(moved.where("a <> b").distinct(), "edges")
    discard(least), discard(edges)
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge up to a node that has none: then all roots are found."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 OR up > least AND least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected ``edges`` (a, b); root is the least node that it reaches.

    Edges are written to the shared folder after each step, so neither lineage nor the driver's memory grows; rounds go on
    until only stars are left, a few for the logarithm of the nodes. Null ends and loops are ignored; repeated edges count
    once; no edges give no rows.
    """
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        edges = _star(_star(edges, small=False), small=True)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
