"""Connected components as Spark jobs: alternating large-star and small-star steps over written edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b: the smallest node of each node's component."""
    label = np.arange(n)
    if not len(a):
        return label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours; combined before the shuffle, written for the join after it."""
    low = pairs.groupBy("u").agg(F.min("v").alias("v"))
    return stored(low.select(F.col("u").alias("c"), F.least("u", "v").alias("m")), "star")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least_neighbour(both)
    out = both.filter("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(out.filter("u <> v").distinct(), "edges")


def _small_star(edges: DataFrame) -> DataFrame:
    low = _least_neighbour(edges)
    hooked = edges.join(low, F.col("u") == F.col("c")).filter("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(hooked.unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
                  .filter("u <> v").distinct(), "edges")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b, longs) but the roots; root is the smallest node.

    Every step writes its edges to the checkpoint folder, so a lost executor costs a re-read. A star with a third of
    all edges is one side of a plain join of two written tables, which adaptive execution splits. There are
    logarithmically many rounds; edges never outnumber those at the start.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        edges = _small_star(_large_star(edges))
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
