"""Connected components of an edge table, without a driver-side or one-task graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the smallest id reachable.

    Each round points every id to its smallest neighbour or itself (partial minima, so
    a hub is combined before the shuffle), follows the pointers a few times and replaces
    edges by those between the ids pointed to; loops go and repeats merge. The smallest
    id of a component never points elsewhere, and a round leaves no id with a smaller
    neighbour alone, so edges run out after a number of rounds that grows with the log
    of the longest path. Every round is written, which cuts the lineage.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        near = edges.select(F.col("a").alias("id"), F.col("b").alias("p")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("p")))
        parent = near.groupBy("id").agg(F.least(F.col("id"), F.min("p")).alias("p"))
        for _ in range(3):
            parent = _followed(staged(parent, "parents"))
        parent = staged(parent, "parents")
        up = parent.select(F.col("id").alias("_i"), F.col("p").alias("_p"))
        if labels is None:
            labels = parent.select("id", F.col("p").alias("component"))
        else:
            labels = labels.join(up, F.col("component") == F.col("_i"), "left").select("id", F.coalesce("_p", "component").alias("component"))
        labels = staged(labels, "labels")
        moved = edges.join(up, F.col("a") == F.col("_i")).select(F.col("_p").alias("a"), "b").join(up, F.col("b") == F.col("_i")).select("a", F.col("_p").alias("b"))
        moved = moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = staged(moved, "edges")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels


def _followed(parent: DataFrame) -> DataFrame:
    """Pointers followed once: the parent of each parent."""
    up = parent.select(F.col("id").alias("_i"), F.col("p").alias("_p"))
    return parent.join(up, F.col("p") == F.col("_i"), "left").select("id", F.coalesce("_p", "p").alias("p"))


class Forest:
    """Union-find over small integers, for the links of one block."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart; they are together after it."""
        ra, rb = self.root(a), self.root(b)
        if ra == rb:
            return False
        self.up[max(ra, rb)] = min(ra, rb)
        return True
