"""Connected components: over a distributed table of links, and over links that are found by scanning."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Links of a node above which its minimum is sent to its links instead of the other way round.
HEAVY = 1 << 16


def _with_least(spark: SparkSession, links: DataFrame, most: int) -> DataFrame:
    """``links`` (a, b), ``most`` or fewer, with m, the smallest b of each a."""
    if most <= HEAVY:
        return links.join(links.groupBy("a").agg(F.min("b").alias("m")), "a")
    least = stored(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), spark)
    heavy = least.filter(F.col("n") > HEAVY).select("a", "m")
    if not heavy.limit(1).count():
        return links.join(least.select("a", "m"), "a")
    light = links.join(F.broadcast(heavy), "a", "left_anti").join(least.filter(F.col("n") <= HEAVY).select("a", "m"), "a")
    return light.unionByName(links.join(F.broadcast(heavy), "a"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a long, b long), root being the smallest node of its component.

    Alternating large-star and small-star rounds. Each is a map-side-combined minimum per node and a join. Nodes with
    more than HEAVY links are joined by broadcast: n links have at most 2 n / HEAVY of them, so a star's links never
    meet in one task. Every round is written to the shared folder, which ends the lineage.
    """
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), spark)
    before, most = None, 2 * links.count()
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(spark, both, most).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).filter("a <> b").distinct()
        small = _with_least(spark, large if most <= HEAVY else stored(large, spark), most)
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        links = stored(small.filter("a <> b").distinct(), spark)
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if state == before:
            break
        before, most = state, 2 * state[0]
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def scan(n: int, linked: Callable[[int], np.ndarray]) -> np.ndarray:
    """Components of 0..n-1, as each one's smallest member, where ``linked(i)`` finds all that i is linked with.

    Members of the smallest components are scanned first, until at most one component has members that weren't:
    by then each link between two components would have been found from one side. No list of pairs is made.
    """
    label, open_ = np.arange(n), np.ones(n, bool)
    while True:
        size = np.bincount(label, minlength=n)
        left = np.flatnonzero(open_)
        if not len(left) or (label[left] == label[left[0]]).all():
            return label
        i = left[np.argmin(size[label[left]])]
        open_[i] = False
        near = np.unique(label[linked(int(i))])
        if len(near) > 1 or near[0] != label[i]:
            hit = np.zeros(n, bool)
            hit[near] = hit[label[i]] = True
            label[hit[label]] = min(int(near[0]), int(label[i]))
