"""Connected components of a link table, as alternating star contractions in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklake.session import discard, materialise


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` of long ids -> ``(node, root)``, root being the smallest id of the component.

    Each round points the larger neighbours of a node at its smallest one (large star), then the smaller
    ones (small star); after some log n rounds only stars are left. Minima combine on the map side and are written
    before they are joined back: both sides then come straight from a shuffle, so that adaptive execution can split
    a node with very many links. Every round is written to the shared folder: a lost executor repeats one round at most.
    No links: no rows. Null ends and links of a node to itself are ignored, repeated links count once.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "cc-edges")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-smallest")
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "cc-large")
        lowest = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc-lowest")
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).distinct()
        small = materialise(small, "cc-small")
        now = _mark(small)
        discard(edges, large, smallest, lowest)
        edges = small
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and two order-free sums over them: equal marks, equal edge sets."""
    half = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))
    other = F.pmod(F.xxhash64("v", "u", F.lit(3)), F.lit(1 << 31))
    return tuple(edges.agg(F.count("*"), F.sum(half), F.sum(other)).first())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reduce a task's links to one edge per node: (node, smallest node reachable), roots left out."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]
