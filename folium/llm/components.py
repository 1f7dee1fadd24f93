"""Connected components of edge tables, and of small matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import Scratch


def connected(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: longs); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer
    change. Edges point from the larger node to the smaller one, so a node's
    smallest neighbour is a minimum over its own edges. Minima are written before
    they are joined: the rows of a hub, such as the root of a large component,
    are then split among tasks. Nothing is collected, and a lost executor costs
    a step's files at most.
    """
    stars = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    mark, step = _mark(stars), 0

    def minima(of: DataFrame, at: str) -> DataFrame:
        return scratch.keep(of.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{at}-{step}").withColumnRenamed("a", "x")

    while mark[0]:
        step += 1
        # Large star: larger neighbours of x go to the smallest neighbour of x, or to x if that is smaller than all.
        low = minima(stars, "large")
        large = scratch.keep(stars.join(low, F.col("b") == F.col("x"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), f"{name}-step-{step}")
        # Small star: smaller neighbours of x, and x, go to the smallest of them.
        low = minima(large, "small")
        pair = lambda of: F.struct(F.col(of).alias("a"), F.col("m").alias("b"))
        small = large.join(low, F.col("a") == F.col("x")).select(F.explode(F.array(pair("a"), pair("b"))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = scratch.keep(small, f"{name}-{step}")
        now = _mark(new)
        scratch.drop(f"{name}-{step - 1}", f"{name}-step-{step}", f"{name}-large-{step}", f"{name}-small-{step}")
        done, stars, mark = now == mark, new, now
        if done:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def roots(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first index of its component."""
    n = len(link)
    out = np.full(n, -1, np.int64)
    alone = ~link.any(1)
    out[alone] = np.flatnonzero(alone)
    for k in range(n):
        if out[k] >= 0:
            continue
        seen = np.zeros(n, bool)
        edge = np.zeros(n, bool)
        seen[k] = edge[k] = True
        while edge.any():
            edge = link[edge].any(0) & ~seen
            seen |= edge
        out[seen] = k
    return out
