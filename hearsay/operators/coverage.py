"""Distinct posts per keyword from stored sketches that merge in any order.

A theta sketch keeps the ``2 ** LG_ENTRIES`` smallest hashes of a set, so a union depends on the
sets alone: not on the order of merging, not on how rows were spread, and a batch that is merged
twice changes nothing. A keyword with up to that many posts is counted exactly; beyond, the relative
error is within :func:`stated_error`. A sketch is at most 8 bytes an entry however many links a
keyword has, and links are folded into it where they are read, before the shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearsay.functions.scalars import utc_day

LG_ENTRIES = 12
_SKETCH = "posts"


def stated_error(lg_entries: int = LG_ENTRIES, deviations: float = 3.0) -> float:
    """Relative error that an estimate keeps with the given number of standard deviations."""
    return deviations / ((1 << lg_entries) - 2) ** 0.5


def coverage_sketches(links: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """day (UTC, of ``fetched_at``), keyword, posts: the sketch of the distinct post ids. Links
    without a post count for none; NULL days and keywords are groups of their own."""
    return links.groupBy(utc_day(F.col("fetched_at")).alias("day"), "keyword").agg(
        F.theta_sketch_agg("post_id", lg_entries).alias(_SKETCH))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """One sketch per day and keyword of several tables of them."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("day", "keyword").agg(F.theta_union_agg(_SKETCH).alias(_SKETCH))


def store_sketches(links: DataFrame, root: str, batch: int, lg_entries: int = LG_ENTRIES) -> None:
    """Sketches of a batch of links, in a folder of its own: a batch written again replaces
    itself, and no batch rewrites another's."""
    coverage_sketches(links, lg_entries).write.mode("overwrite").parquet(f"{root}/batch={batch}")


def stored_sketches(spark: SparkSession, root: str) -> DataFrame:
    """All sketches stored below ``root``; several rows per day and keyword."""
    return spark.read.parquet(root).drop("batch")


def coverage(sketches: DataFrame, by: Sequence[str] = ("keyword",), since: str | None = None,
             until: str | None = None) -> DataFrame:
    """n_posts (about) per ``by`` (any of day and keyword, or nothing for all), of the days from
    ``since`` to ``until`` (both inclusive). Only sketches are read, never links."""
    if since is not None:
        sketches = sketches.where(F.col("day") >= since)
    if until is not None:
        sketches = sketches.where(F.col("day") <= until)
    return sketches.groupBy(*by).agg(
        F.theta_sketch_estimate(F.theta_union_agg(_SKETCH)).alias("n_posts"))


def shared_coverage(sketches: DataFrame, one: str, other: str) -> DataFrame:
    """n_posts (about) that two keywords have in common."""
    both = sketches.where(F.col("keyword").isin(one, other)).groupBy("keyword").agg(
        F.theta_union_agg(_SKETCH).alias(_SKETCH))
    common = F.theta_sketch_estimate(F.theta_intersection_agg(_SKETCH))
    return both.agg(F.when(F.count(F.lit(1)) == 2, common).otherwise(
        F.lit(0)).cast("bigint").alias("n_posts"))
