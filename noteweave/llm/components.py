"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def star_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the edges (a, b), in numpy."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) of every node that has an edge.

    edges: a and b, longs; loops and repeated edges do no harm, edges with a null end are
    left out.  A round takes a constant number of shuffles of the edges that are left,
    hot nodes included: a node's smallest neighbour is a map-side aggregate, and joins
    back to that node's edges, which skew handling can split.  The rounds grow with the
    logarithm of the number of nodes.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = state(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        small = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no stable components after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
