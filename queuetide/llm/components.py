"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


class UnionFind:
    """Over numbers 0 to n - 1; the smaller root wins."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches):
    """Each batch's edges as a star per component of the batch."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
        sets = UnionFind(len(nodes))
        for x, y in zip(codes[:len(a)].tolist(), codes[len(a):].tolist()):
            sets.union(x, y)
        roots = np.array([sets.find(i) for i in range(len(nodes))])
        rest = np.flatnonzero(roots != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(nodes[roots[rest]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    ``edges`` has long columns a and b, in any direction and number; loops and nulls do
    not count. Each round is written to the shared folder and replaces the last.
    """
    forest = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a != b")
    current = written(forest.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    last = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        following = written(small.select("e.a", "e.b").where("a != b").distinct(), "edges")
        state = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(current)
        current = following
        if state == last:
            break
        last = state
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
