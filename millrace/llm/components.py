"""Connected components by alternating large and small stars, in rounds of written tables.

In a large star every node hangs its larger neighbours on its least neighbour; in a small star it
hangs its smaller neighbours and itself there. Stars remain, each around its least node. Minima are
combined before the shuffle; they are written before they are joined, so that the join's shuffle
partitions can be split when one node has very many neighbours.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import stage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of some nodes as stars: (node, least node of its component), roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = stage(large.filter("a <> b").distinct(), "large")
    least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
    small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the links (a, b); root is the component's least node."""
    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = state(edges)
    while seen[0]:
        edges = _round(edges)
        before, seen = seen, state(edges)
        if before == seen:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
