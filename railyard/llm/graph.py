"""Connected components of links, all in joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable number of each of ``n`` points linked by pairs, and
    by a forest found before."""
    root = np.arange(n) if root is None else root.copy()
    while len(a):
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = lo < hi
        if not open_.any():
            break
        a, b, lo, hi = a[open_], b[open_], lo[open_], hi[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every linked node, root the smallest node reachable.

    ``links`` has columns ``a, b``.  Alternates two steps until nothing
    changes: every larger neighbour of a node is linked to the node's
    smallest neighbour, then every smaller one is.  Each round is a written
    table, so a lost executor repeats one round at most; minima are combined
    before the shuffle and joined back, so no node's links meet in one task.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"),
                                                   F.least("a", "b").alias("v")).distinct(), "links")

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    last = state(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "small-star")
        now = state(edges)
        if now == last:
            break
        last = now
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)
