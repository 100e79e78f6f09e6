"""Connected components over edges that lie in tables, by alternating stars.

Each round first links every larger neighbour of a node to the least node near it,
then every smaller one; the edges become stars around the least node of each
component after a number of rounds about logarithmic in the longest path.  Minima
are partial aggregates.  They are written before the edges are joined with them,
so that both sides of the join come from plain exchanges and the rows of a hub
can be split among tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import Scratch


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``edges``: ``a``, ``b`` of type long, in any order.  Returns ``node`` and
    ``root``, the least node of its component, for each node that has an edge."""
    e = scratch.table(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        near = e.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        low = scratch.table(near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large")
        # A node's smaller neighbours after the large star are the minima near its old ones.
        large = scratch.table(e.join(low, e.b == low.u).select("a", F.col("m").alias("b")).distinct(), "star")
        low2 = scratch.table(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "small")
        joined = large.join(low2, large.a == low2.u).select("a", "b", "m")
        pairs = joined.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p"))
        new = scratch.table(pairs.select("p.a", "p.b").where("a != b").distinct(), "edges")
        state = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        for old in (e, low, large, low2):
            scratch.drop(old)
        e = new
        if state == before or not state[0]:
            break
        before = state
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class Union:
    """Components within one task: labels that arrays of links lower."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up
