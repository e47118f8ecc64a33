"""Connected components: within an array by numpy, over a cluster by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.shared import Scratch


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace the edges ``a-b`` by as few that connect the same: each node and the least node of its component."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)`` (long), root the least node of its component.

    Large-star and small-star rounds (Kiveris et al., 2014) until no edge changes. Each round is two
    aggregations with map-side combine and joins that adaptive execution splits where a hub is hot;
    its edges are staged in the shared folder, so lineage stays short. No node, edge or component
    is collected. Self-loops, repeated edges and an empty table are fine; NULL ends are ignored.
    """
    e = scratch.put(_tidy(edges), "edges")
    last = None
    while True:
        e = scratch.put(_small(_large(e)), "edges")
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        scratch.drop_named("edges", but_last=1)
        if now == last:
            break
        last = now
    root = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _tidy(e: DataFrame) -> DataFrame:
    """Each edge once, from the greater node to the lesser."""
    return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
    return _tidy(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return _tidy(e.join(least, "a").select("b", "m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))
