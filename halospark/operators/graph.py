"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, discard


def joined(up: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inside a task: `up`, the smallest member of each one's set, after the sets of one[k] and two[k] became one."""
    one, two = up[one], up[two]
    while (apart := one != two).any():
        one, two = one[apart], two[apart]
        np.minimum.at(up, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(higher := up[up], up):
            up = higher
        one, two = up[one], up[two]
    return up


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, root): the smallest node of each connected component, for every node that a pair names.

    Alternating large-star and small-star steps, each an aggregation and a join on a node; the edge table is written after
    every round, which hooks all nodes of a long chain to ever smaller ones in about the logarithm of its length. Nulls and
    loops are ignored; an empty input gives an empty table."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, now = now, cut(small.filter("a <> b").distinct())
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:  # a round that changes nothing
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
