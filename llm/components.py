"""Connected components of a graph too large for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from llm.shared import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its
    smallest node.

    Alternates two local steps: every node passes its smallest neighbour to its larger ones, then
    to its smaller ones. The paths shrink to stars in a logarithmic number of rounds. Each round is
    written to the shared folder; only a count and a checksum come to the driver.
    """
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = cut(flat.distinct(), "edges")
    state = _state(stars)
    while state[0]:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").where("a <> b").distinct()
        new = cut(small, "edges")
        drop(stars)
        stars, before, state = new, state, _state(new)
        if state == before:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def roots(n: int, a: np.ndarray, b: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For ``n`` local items linked by pairs (a, b): the smallest ``name`` each one reaches."""
    low = name.copy()
    while len(a):
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        if (new == low).all():
            break
        low = new
    return low
