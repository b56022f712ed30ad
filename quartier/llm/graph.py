"""Connected components of an edge table, and a small union-find for use inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import io


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) edges: root is the least node that it reaches.

    Alternates the two star contractions until the edges no longer change: each round joins every node's
    larger, then smaller neighbours to the least one. Every round is written to the shared folder.
    """
    edges = io.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = io.written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = io.written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


class UnionFind:
    """Groups of positions 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart until now."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of edges that suffice to connect what all edges connect."""
    sets = UnionFind(n)
    return [i for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if sets.join(x, y)]
