"""Connected components by alternating star contraction: every step is a partial aggregation and a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.store import Work


class Forest:
    """Disjoint sets within one task; edges: the links that joined two of them."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, pairs: np.ndarray) -> None:
        """pairs: two rows of nodes."""
        while pairs.shape[1]:
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]
            a, b = self.up[pairs[0]], self.up[pairs[1]]
            pairs, a, b = pairs[:, a != b], a[a != b], b[a != b]
            if not len(a):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            _, one = np.unique(high, return_index=True)  # each root is hung once a round
            self.up[high[one]] = low[one]
            self.edges += list(zip(pairs[0, one].tolist(), pairs[1, one].tolist()))


def components(edges: DataFrame, work: Work) -> DataFrame:
    """edges: a, b (long). One row (node, comp) per node that has an edge; comp is the smallest node reachable.

    No node's neighbours are ever gathered in one place: a node's smallest neighbour is a partial aggregate, and the join
    that spreads it is one that Spark splits where a node has very many. Ends when the edges are stars.
    """
    e = work.put(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    before = None
    while True:
        both = e.unionByName(e.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        one = work.put(large)
        low = one.groupBy("a").agg(F.min("b").alias("m"))
        small = one.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        two = work.put(small.selectExpr("greatest(a, b) a", "least(a, b) b").where("a <> b").distinct())
        work.drop(e, one)
        e = two
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
