"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.sources.store import forget, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that can be reached.

    In each round nodes hook onto their smallest neighbour, chains are shortened until they end at a root, and edges
    are drawn between roots, once each; so each round at least halves the nodes with edges, whatever their degrees.
    Every step is a stored table, which bounds the lineage; those done with are deleted. Null ends and loops are left out.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = stored(edges.filter("a <> b").select(low, high).distinct(), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        hooks = stored(hooks.select("node", F.least("node", "root").alias("root"), F.lit(True).alias("moved")), "hooks")
        while not hooks.filter("moved").isEmpty():
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            nearer = hooks.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), (F.col("top") != F.col("root")).alias("moved"))
            hooks, before = stored(nearer, "hooks"), hooks
            forget(before)
        levels.append(hooks)
        drawn = edges.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        drawn = drawn.join(hooks.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").filter("x <> y")
        edges, before = stored(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"), edges
        forget(before)
    if not levels:
        out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        out.stored_at = edges.stored_at
        return out
    found = levels.pop()
    while levels:
        own, above = levels.pop(), found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found, before = stored(own.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots"), found
        forget(own, before)
    out = found.select("node", F.col("root").alias("component"))
    out.stored_at = found.stored_at
    return out
