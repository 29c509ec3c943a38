"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of an edge table (a, b), root the smallest node of its component.

    Alternates two steps: every node ties its larger neighbours to its smallest one, then
    its smaller neighbours; long chains shorten to stars in logarithmically many rounds. It
    ends when every node has one tie at most, to a node without any. Self-loops give a
    component of one. An empty table gives no rows.
    """
    own = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    e = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = stash(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        least = stash(large.groupBy("x").agg(F.min("y").alias("m")), "least")
        tied = large.join(least, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        e = stash(tied.unionByName(least.select("x", F.col("m").alias("y"))).distinct(), "edges")
    roots = e.select(F.col("y").alias("node"), F.col("y").alias("root"))
    return e.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(roots).unionByName(own).groupBy("node").agg(F.min("root").alias("root"))


def _stars(e: DataFrame) -> bool:
    ends = e.select(F.col("x").alias("node"), F.lit(1).alias("ties"), F.lit(0).alias("tied")).unionByName(e.select(F.col("y").alias("node"), F.lit(0).alias("ties"), F.lit(1).alias("tied")))
    open_ends = ends.groupBy("node").agg(F.sum("ties").alias("ties"), F.max("tied").alias("tied")).filter("ties + tied > 1 and ties > 0")
    return not open_ends.take(1)


class Forest:
    """Components among numbered rows in memory; joined yields each edge that ties two of them."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def joined(self, i: int, near: np.ndarray, allowed=None):
        """Ties row i to the rows of near that aren't in its component yet, where allowed(i, j) holds."""
        for j in near[self.label[near] != self.label[i]].tolist():
            if self.label[j] != self.label[i] and (allowed is None or allowed(i, j)):
                low, high = sorted((self.label[i], self.label[j]))
                self.label[self.label == high] = low
                yield i, j
