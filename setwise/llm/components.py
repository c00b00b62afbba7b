"""Connected components of an edge table by alternating large and small stars.

Every round is two grouped minima and joins on a node; a hub's edges are
pre-aggregated for the minimum and split by AQE in the join. Rounds are about
logarithmic in the diameter, and each is written to the shared folder, the one
before it removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from setwise.llm.store import Scratch


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) and each u's smallest neighbour or itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str, b: str, hold: Scratch) -> DataFrame:
    """(node, component) for every node of an edge that is not the smallest of its component.

    Edges are undirected; loops and NULL ends are ignored. Nodes that are not
    listed, and the smallest of each component, are their own component.
    """
    now = hold.table(edges.where(f"`{a}` <> `{b}`").select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        rows = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))).distinct()
        later = hold.table(rows, "star")
        hold.drop(now)
        now = later
        # Done when every node hangs on one root, and no root hangs on another.
        many = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        roots = now.select(F.col("v").alias("u")).distinct().join(now, "u", "left_semi").limit(1)
        if not many.select("u").union(roots.select("u")).take(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
