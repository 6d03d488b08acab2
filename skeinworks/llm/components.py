"""Connected components of links between ids, by alternating stars.

In a large-star step every node links its larger neighbours to the least id that it sees;
in a small-star step its smaller ones. Both are a groupBy(min) and a join on the node, so a
hub's links are summed before the shuffle and its join partition can be split. The number of
rounds grows with the logarithm of the size; each round's links are stored, which cuts the
lineage, and those of the round before are deleted. Nothing but the count of changes comes to
the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from skeinworks.session import discard, stored


def _star(links: DataFrame, larger: bool) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    seen = both.join(low, "a")
    if larger:
        out = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """links: pairs of ids, in any order, repeated or not; null or equal ends are ignored.
    Returns id, component (the least id reachable) for every id that has a link."""
    pairs = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct()
    now = stored(pairs, "links")
    mark = None
    while True:
        large = stored(_star(now, True), "links")
        small = stored(_star(large, False), "links")
        discard(now, large)
        now = small
        # A step only moves links to smaller ends: equal sums of both ends mean no change.
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == mark or not got[0]:
            break
        mark = got
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def local_stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least reachable index of each of n nodes, given links a[i]-b[i], in one task."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root
