"""From search hits to the posts worth fetching, and what came of it."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from hearsay.operators.merge import first_wins
from hearsay.operators.shared import top_k_per_key

KEYS = ["keyword", "platform"]


def capped_hits(hits: DataFrame, count: int, order: Sequence[str]) -> DataFrame:
    """The first ``count`` distinct posts of every keyword and platform in hit order.

    Repeated hits collapse map-side before the cap.
    """
    distinct = first_wins(
        hits.select(*KEYS, "post_id", *order).where(F.coalesce("post_id", F.lit("")) != ""),
        [*KEYS, "post_id"], order,
    )
    return top_k_per_key(distinct, KEYS, [F.asc(o) for o in [*order, "post_id"]], count, "hit")


def worklist(
    hits: DataFrame, seen: DataFrame, count: int, order: Sequence[str], only_new: bool = True
) -> DataFrame:
    """Ranked posts to fetch: deduplicate, cap, then drop the already seen, rank 1..k.

    The cap comes before the seen filter, so fewer than ``count`` may remain.
    """
    capped = capped_hits(hits, count, order)
    if only_new:
        capped = capped.join(seen.select(*KEYS, "post_id"), [*KEYS, "post_id"], "left_anti")
    ranked = top_k_per_key(capped, KEYS, [F.asc("hit")], count)
    return ranked.select(*KEYS, "post_id", F.col("rank").cast("bigint").alias("rank"))


def worklist_skipped(
    hits: DataFrame, seen: DataFrame, count: int, order: Sequence[str]
) -> DataFrame:
    """Per keyword and platform: posts after the cap, already seen ones, and the rest."""
    marked = capped_hits(hits, count, order).join(
        seen.select(*KEYS, "post_id").distinct().withColumn("was_seen", F.lit(True)),
        [*KEYS, "post_id"], "left",
    )
    return marked.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("capped"), F.count("was_seen").alias("skipped"),
    ).withColumn("kept", F.col("capped") - F.col("skipped"))


def hits_to_parents(hits: DataFrame, count: int, order: Sequence[str]) -> DataFrame:
    """Question ids of search hits (kind, target_id, parent_id): the hit itself or, for an
    answer, its question; numeric ones only, distinct in hit order, at most ``count`` per
    keyword."""
    question = F.when(F.col("kind") == "question", F.col("target_id")).when(
        F.col("kind") == "answer", F.col("parent_id")
    )
    ids = hits.select(
        "keyword", F.lit("zhihu").alias("platform"),
        F.trim(question).try_cast("bigint").cast("string").alias("post_id"), *order,
    )
    out = capped_hits(ids.where(F.col("post_id").isNotNull()), count, order)
    return out.select(
        "keyword", F.col("post_id").cast("bigint").alias("question_id"),
        F.col("hit").cast("bigint").alias("rank"),
    )


def run_outcomes(items: DataFrame) -> DataFrame:
    """Per run: succeeded, failed, skipped and requested items.

    ``items`` has run_id and outcome ('ok', 'failed' or 'skipped').
    """
    return items.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("requested"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "failed", "skipped")],
    )


def run_error_tally(items: DataFrame) -> DataFrame:
    """Failures per run and error name, most frequent first."""
    return (
        items.where(F.col("outcome") == "failed")
        .groupBy("run_id", "error").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("run_id", F.desc("n"), "error")
    )
