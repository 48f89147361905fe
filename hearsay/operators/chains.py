"""Page sequences that are only linked by cursors."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later rounds neither recompute
    it nor depend on the executors that made it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pages_by_cursor(
    pages: DataFrame, keys: Sequence[str], cursor: str, next_cursor: Column,
    empty: Column | None = None, ended: Column | None = None, first: Sequence[str] = ("",),
) -> DataFrame:
    """The pages that a reader of each request reaches, with ``page_no`` from 1.

    A page was asked for with ``cursor`` and names ``next_cursor``. Reading begins at a page
    whose cursor is one of ``first`` (NULL counts as '') and goes on to the page of the same
    request with the next cursor, until there is none: the chain is broken, a page is ``empty``
    (it is not kept), it has ``ended`` (it is the last), names no next cursor, or names one that
    was read before. Pages landed twice keep one number; if they name different next cursors, the
    smallest counts. Requests with a NULL key have no pages.

    Positions come from pointer doubling over narrow rows (keys and two cursors): in round k every
    page knows the page 2**k further on, and the first 2**k pages of each chain find the next
    2**k. A chain of n pages takes log2(n) rounds, and a request that owns a third of all pages
    is spread by its cursors. Bodies move once, at the end.
    """
    on = [*keys, "_at"]
    at = F.coalesce(F.col(cursor).cast("string"), F.lit(""))
    no = F.lit(False)
    empty, ended = (no if c is None else F.coalesce(c, no) for c in (empty, ended))
    named = F.nullif(next_cursor.cast("string"), F.lit(""))
    nodes = stored(
        pages.where(~empty).select(*keys, at.alias("_at"), F.when(~ended, named).alias("_next"))
        .groupBy(*on).agg(F.min("_next").alias("_next")), "chain")
    landed = nodes.select(*keys, F.col("_at").alias("_next"))
    jump = nodes.join(landed, [*keys, "_next"], "left_semi").select(*on, "_next")
    ranks = [nodes.where(F.col("_at").isin(*first)).select(*on, F.lit(1).alias("page_no"))]
    step = 1
    while True:
        jump = stored(jump, "chain-jump")
        known = reduce(DataFrame.union, ranks)
        ahead = known.join(jump, on).select(
            *keys, F.col("_next").alias("_at"), (F.col("page_no") + step).alias("page_no"))
        fresh = stored(ahead.join(known, on, "left_anti").groupBy(*on).agg(
            F.min("page_no").alias("page_no")), "chain-rank")
        if fresh.isEmpty():
            break
        ranks.append(fresh)
        further = jump.select(*keys, F.col("_at").alias("_next"), F.col("_next").alias("_far"))
        jump = jump.join(further, [*keys, "_next"]).select(*on, F.col("_far").alias("_next"))
        step *= 2
    return pages.where(~empty).withColumn("_at", at).join(known, on).drop("_at").select(
        *pages.columns, "page_no")
