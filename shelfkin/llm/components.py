"""Connected components of a table of edges by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.lineage import materialise


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is one of its component.

    In each round every node moves to its smallest neighbour (or stays) and edges move along;
    the edges that are left join fewer and fewer nodes. Nodes should be hashes, so that chains
    shrink by a constant share. A star is done after two rounds, whatever its size.
    """
    left = materialise(edges.filter("a != b").select("a", "b").distinct())
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
        if found is None:
            found = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            moved = step.select(F.col("a").alias("root"), "to")
            found = materialise(
                found.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            )
        a, b = (step.select(F.col("a").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        moved = left.join(a, "a").join(b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        left = materialise(moved.filter("a != b").distinct())
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
