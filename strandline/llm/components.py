"""Connected components of a graph in a table, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges, and the least node that these edges join each to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def connected_components(edges: DataFrame, rounds: int = 60, files: int | None = None) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for each node of ``edges`` (a, b longs).

    Large-star and small-star steps in turn, until the edges stay as they are and
    every node points at its root: a number of rounds that grows with the
    logarithm of the graph. Each round's edges, no more than the first ones, are a
    table in the shared folder. A node with very many neighbours is a skewed key
    of a join with one row for each node, which adaptive execution splits. The result
    reads the last round's table, of at most ``files`` files if given.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", files=files)
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "edges", files=files)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # A larger node's smaller neighbours, and the node itself, all go to the least of them.
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        new = cut(small.filter("a <> b").distinct(), "edges", files=files)
        drop_cut(now)
        drop_cut(large)
        now = new
    else:
        raise RuntimeError("components have not settled")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
