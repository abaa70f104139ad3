"""Connected components: within one task over arrays, and over a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize


class LocalComponents:
    """Union-find over 0..n-1 that takes arrays of links; the root is the smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Every member that is not a root, and its root."""
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return child, self.root[child]


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, component), the smallest node that is reachable; only nodes
    with a link to another node appear.  Links to itself and with nulls are ignored.

    Alternates two steps until every component is a star around its smallest node: each node hands
    its larger neighbours to the smallest node it knows, then each node hands its smaller ones
    there.  Both keep the components and need a number of rounds logarithmic in the longest chain.
    Minima are written out before the join, so that a join on a node with very many links is
    between two plain exchanges, which Spark may split.
    """
    stars = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a > b").distinct()
    stars = materialize(stars, "links")
    while not _are_stars(stars):
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        # From each node's side: its larger neighbours go to the smallest node it knows.
        up = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        up = materialize(up, "links")
        least = materialize(up.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = up.join(least, "a")
        down = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a > b").distinct()
        stars = materialize(down, "links")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(stars.select(F.col("b"), F.col("b")).distinct())


def _are_stars(links: DataFrame) -> bool:
    """Whether no node hangs on two nodes, or on a node that hangs on another."""
    if links.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        return False
    return links.join(links.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0
