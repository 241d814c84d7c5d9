"""Connected components of an edge list by alternating large-star and small-star steps; nothing is gathered on the driver.

A node of many neighbours is met by its edges where they are (``spread_join``), so no task reads all edges of one node.

Rows: edges with a null end, and from a node to itself, are left out; repeated edges count once; no edges give no rows. Further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.shared import spread_join, stored


def _star(edges: DataFrame, total: int, most: int, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to its least neighbour. Edges are (u, v) with u > v, total of them, most at one node."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    linked = spread_join(both, least, "u", "degree", F.xxhash64("u", "v"), 2 * total, most)
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # a node's smaller neighbours and the node itself go to the least of them
    return linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> tuple[bool, int, int]:
    """Whether each node has one root and no root has another, how many edges there are, and the most at one node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0), F.lit(1)))
    by_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"), F.count("*").alias("degree"))
    roots, total, degree = by_node.agg(F.max(F.col("up") + F.col("root")), F.sum("up"), F.max("degree")).first()
    return (roots or 0) <= 1, total or 0, degree or 0


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the least node of its component.

    Each round is written to the shared folder, so the lineage stays short; their number grows with the logarithm of the longest path.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    for _ in range(rounds):
        done, total, most = _settled(edges)
        if done:
            break
        # neither step makes more edges, of all or down from a node; the second reads the exchange of the first twice
        larger = _star(edges, total, most, True)
        edges = stored(_star(larger, total, most, False).where("u > v"), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
