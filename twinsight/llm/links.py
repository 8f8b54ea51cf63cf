"""From links to components: spanning forests within a task, stars across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stage


class Forest:
    """Union-find over positions, fed with arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        while len(a):
            ra, rb = parent[a], parent[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each position that is not a root, and its root: fewer edges than positions."""
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]


def _smallest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, combined before the shuffle; staged so that a join with a hot node can be split."""
    return stage(edges.groupBy("u").agg(F.min("v").alias("m")), "smallest")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in `edges` (u long, v long); component is the smallest id reachable.

    Alternates large-star and small-star steps until nothing changes: about
    log-squared many rounds for any shape of graph. Each round is written to
    the shared folder. Null ends and loops are ignored; no rows give no rows.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_smallest(both), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stage(large.where("u > v").distinct(), "edges")
        low = _smallest(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        now = stage(small.where("u > v").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
