"""Volume, totals, distributions, rankings and growth."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearsay.functions.scalars import shorten, utc_day, utc_text
from hearsay.operators.retrieve import (
    Corpus, answer_ids, answers_for_keyword, linked_posts, newest_first, posts_for_keyword,
)
from hearsay.operators.shared import previous_in_blocks, repeat_rows, top_k_per_key
from hearsay.schema import PLATFORMS

COUNTERS = ("view_count", "like_count", "comment_count", "favorite_count", "share_count")
_TOTALS = {
    "total_comments": "comment_count",
    "total_likes": "like_count",
    "total_favorites": "favorite_count",
    "total_views": "view_count",
}


def _total(column: str, weight: Column) -> Column:
    """Sum over links; a sum of NULLs is 0."""
    return F.coalesce(F.sum(F.col(column) * weight), F.lit(0)).cast("bigint")


def _by_keyword(keyword: str) -> Column:
    return F.col("keyword") == keyword


def _volume(posts: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    return (
        posts.where(F.col("published_at").isNotNull())
        .withColumn("day", utc_day(F.col("published_at")))
        .groupBy(*keys, "day", "platform")
        .agg(
            F.sum(weight).cast("bigint").alias("n_posts"),
            *[_total(c, weight).alias(name) for name, c in _TOTALS.items()],
        )
        .orderBy(*keys, "day", "platform")
    )


def volume_by_day(c: Corpus, keyword: str, distinct_posts: bool = False) -> DataFrame:
    """Posts and their counters per publish day (UTC) and platform."""
    posts = linked_posts(c, _by_keyword(keyword))
    weight = F.lit(1).cast("bigint") if distinct_posts else F.col("n_links")
    return _volume(posts, [], weight)


def volume_by_day_all_keywords(c: Corpus) -> DataFrame:
    """The same for every keyword in one pass."""
    return _volume(linked_posts(c, by=["keyword"]), ["keyword"], F.col("n_links"))


def volume_pivot(c: Corpus, keyword: str) -> DataFrame:
    """Posts per day with one column per platform, 0 where there are none."""
    return (
        volume_by_day(c, keyword)
        .groupBy("day").pivot("platform", list(PLATFORMS)).agg(F.sum("n_posts"))
        .fillna(0).orderBy("day")
    )


def _kpis() -> list[Column]:
    n = F.col("n_links")
    return [
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_posts"),
        *[
            F.coalesce(F.sum(F.when(F.col("platform") == p, n)), F.lit(0)).cast("bigint")
            .alias(f"n_{p}")
            for p in PLATFORMS
        ],
        *[_total(col, n).alias(name) for name, col in _TOTALS.items()
          if name != "total_favorites"],
        utc_day(F.min("published_at")).alias("first_day"),
        utc_day(F.max("published_at")).alias("last_day"),
    ]


def overview_kpis(c: Corpus, keyword: str) -> DataFrame:
    """One row: posts in total and per platform, counter sums, publish range."""
    return linked_posts(c, _by_keyword(keyword)).agg(*_kpis())


def overview_kpis_all_keywords(c: Corpus) -> DataFrame:
    """The same row for every keyword that reaches a post, in one pass."""
    return linked_posts(c, by=["keyword"]).groupBy("keyword").agg(*_kpis()).orderBy("keyword")


def platform_counts(c: Corpus, keyword: str) -> DataFrame:
    """Posts of a keyword per platform, largest first."""
    return (
        linked_posts(c, _by_keyword(keyword))
        .groupBy("platform").agg(F.sum("n_links").cast("bigint").alias("n_posts"))
        .orderBy(F.desc("n_posts"), "platform")
    )


def _comparison(posts: DataFrame, keys: Sequence[str]) -> DataFrame:
    rolled = F.when(F.col("platform").startswith("zhihu_"), "zhihu").otherwise(F.col("platform"))
    return (
        posts.groupBy(*keys, rolled.alias("platform"))
        .agg(*[_total(col, F.col("n_links")).alias(col) for col in _TOTALS.values()])
        .unpivot([*keys, "platform"], list(_TOTALS.values()), "metric", "total")
        .select(*keys, "metric", "platform", "total")
        .orderBy(*keys, "metric", "platform")
    )


def platform_comparison(c: Corpus, keyword: str) -> DataFrame:
    """Counter totals per metric and platform, with both zhihu kinds as one."""
    return _comparison(linked_posts(c, _by_keyword(keyword)), [])


def platform_comparison_all_keywords(c: Corpus) -> DataFrame:
    """The same for every keyword in one pass."""
    return _comparison(linked_posts(c, by=["keyword"]), ["keyword"])


def engagement_histogram_all_keywords(c: Corpus, metric: str = "like_count",
                                      bins: int = 29) -> DataFrame:
    """:func:`engagement_histogram` of every keyword. Equal values of a keyword are one counted
    row before the range of the keyword is joined to them."""
    direct = linked_posts(c, by=["keyword"]).select(
        "keyword", F.col(metric).alias("value"), "n_links")
    answers = c.posts.where(F.col("platform") == "zhihu_answer").join(
        answer_ids(c, c.links, ["keyword"]), "post_id"
    ).select("keyword", F.col(metric).alias("value"), F.lit(1).cast("bigint").alias("n_links"))
    counted = (
        direct.unionByName(answers).where(F.col("value") > 0)
        .groupBy("keyword", "value").agg(F.sum("n_links").alias("n"))
    )
    value = F.col("value").cast("double")
    ranges = counted.groupBy("keyword").agg(
        F.ln(F.min(value)).alias("lo"),
        ((F.ln(F.max(value) + 1) - F.ln(F.min(value))) / bins).alias("step"))
    number = F.floor((F.ln(value) - F.col("lo")) / F.col("step"))
    edge = lambda i: F.round(F.exp(F.col("lo") + (F.col("bin") + i) * F.col("step")), 6)
    return (
        counted.join(ranges, "keyword")
        .withColumn("bin", F.least(F.greatest(number, F.lit(0)), F.lit(bins - 1)).cast("bigint"))
        .groupBy("keyword", "bin", "lo", "step").agg(F.sum("n").cast("bigint").alias("n"))
        .select("keyword", "bin", edge(0).alias("left_edge"), edge(1).alias("right_edge"), "n")
        .orderBy("keyword", "bin")
    )


def engagement_histogram(c: Corpus, keyword: str, metric: str = "like_count",
                         bins: int = 29) -> DataFrame:
    """Log-spaced histogram of a positive metric over posts and nested answers.

    Values are counted first: the range and the bins both come from the distinct values and
    share the exchange of their aggregate. The last bin includes its right edge.
    """
    direct = linked_posts(c, _by_keyword(keyword)).select(
        F.col(metric).alias("value"), "n_links"
    )
    answers = answers_for_keyword(c, keyword, ordered=False).select(
        F.col(metric).alias("value"), F.lit(1).cast("bigint").alias("n_links")
    )
    counted = (
        direct.unionByName(answers).where(F.col("value") > 0)
        .groupBy("value").agg(F.sum("n_links").alias("n"))
    )
    value = F.col("value").cast("double")
    low = F.ln(counted.agg(F.min(value)).scalar())
    high = F.ln(counted.agg(F.max(value) + 1).scalar())
    step = (high - low) / bins
    number = F.floor((F.ln(F.col("value").cast("double")) - low) / step)
    return (
        counted.select(
            F.least(F.greatest(number, F.lit(0)), F.lit(bins - 1)).cast("bigint").alias("bin"),
            "n", low.alias("lo"), step.alias("step"),
        )
        .groupBy("bin", "lo", "step").agg(F.sum("n").cast("bigint").alias("n"))
        .select(
            "bin",
            F.round(F.exp(F.col("lo") + F.col("bin") * F.col("step")), 6).alias("left_edge"),
            F.round(F.exp(F.col("lo") + (F.col("bin") + 1) * F.col("step")), 6)
            .alias("right_edge"),
            "n",
        )
        .orderBy("bin")
    )


def keyword_coverage(links: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct keywords and distinct posts among the links."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return links.agg(
        count("keyword").alias("n_keywords"), count("post_id").alias("n_posts")
    )


def top_linked_keywords(links: DataFrame, n: int = 5) -> DataFrame:
    """Keywords with the most links."""
    return (
        links.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_links"))
        .orderBy(F.desc("n_links"), "keyword").limit(n)
    )


def engagement_history(snapshots: DataFrame, post_id: str) -> DataFrame:
    """Counters of one post over time."""
    return (
        snapshots.where(F.col("post_id") == post_id)
        .withColumn("snapshot_time", utc_text(F.col("fetched_at")))
        .select("platform", "post_id", "snapshot_time", *COUNTERS)
        .orderBy("snapshot_time", "platform")
    )


def engagement_growth(snapshots: DataFrame, block_seconds: int = 86400) -> DataFrame:
    """Change of every counter since the post's previous snapshot, and per hour.

    Snapshots are unique per post and second, so a day of a busy post is at most 86,400 rows;
    see :func:`previous_in_blocks`.
    """
    rows = previous_in_blocks(
        snapshots, ["platform", "post_id"], "fetched_at", COUNTERS, block_seconds
    )
    seconds = F.col("fetched_at") - F.col("prev.fetched_at")
    deltas = [(F.col(m) - F.col(f"prev.{m}")).alias(f"{m}_delta") for m in COUNTERS]
    rates = [
        F.round((F.col(m) - F.col(f"prev.{m}")) * 3600 / seconds, 6).alias(f"{m}_per_hour")
        for m in COUNTERS
    ]
    return rows.select(
        "platform", "post_id", "fetched_at", seconds.alias("seconds"), *deltas, *rates
    )


def post_label() -> Column:
    """Title, else the start of the content, else a placeholder; at most 50 characters."""
    text = F.coalesce("title", F.substring("content", 1, 40), F.lit("(no title)"))
    return shorten(text, 50)


def top_posts(c: Corpus, keyword: str, metric: str = "comment_count", n: int = 10) -> DataFrame:
    """Posts of a keyword with the highest metric.

    The best ``n`` distinct posts are enough before repeating them per link.
    """
    order = [F.desc(metric), *newest_first()]
    best = (
        linked_posts(c, _by_keyword(keyword)).where(F.col(metric).isNotNull())
        .select("platform", "post_id", "published_at", metric, post_label().alias("label"),
                "n_links")
        .orderBy(*order).limit(n)
    )
    return (
        repeat_rows(best.withColumn("n_links", F.least("n_links", F.lit(n).cast("bigint"))),
                    "n_links")
        .orderBy(*order).limit(n)
        .select("platform", "post_id", "label", metric)
    )


def top_posts_all_keywords(c: Corpus, metric: str = "comment_count", n: int = 10) -> DataFrame:
    """The ``n`` best distinct posts of every keyword, ranked."""
    posts = (
        linked_posts(c, by=["keyword"]).where(F.col(metric).isNotNull())
        .select("keyword", "platform", "post_id", "published_at", metric,
                post_label().alias("label"))
    )
    ranked = top_k_per_key(posts, ["keyword"], [F.desc(metric), *newest_first()], n)
    return ranked.select("keyword", "rank", "platform", "post_id", "label", metric)


def posts_table(c: Corpus, keyword: str, n: int = 15) -> DataFrame:
    """Posts by comments, then likes."""
    return posts_for_keyword(c, keyword, ordered=False).orderBy(
        F.desc_nulls_last("comment_count"), F.desc_nulls_last("like_count"),
        "platform", "post_id",
    ).limit(n).select("platform", "post_id", "title", "comment_count", "like_count",
                      "view_count")


def top_answers(c: Corpus, keyword: str, n: int = 5) -> DataFrame:
    """The most voted answers under a keyword's questions."""
    return answers_for_keyword(c, keyword, ordered=False).orderBy(
        F.desc_nulls_last("like_count"), "post_id"
    ).limit(n).select("post_id", "author_name", "like_count", "comment_count", "content")


def sample_posts_with_top_comment(c: Corpus, keyword: str, n: int = 5) -> DataFrame:
    """The ``n`` most liked posts (most commented if none has likes), each with a content
    preview and its best comment.

    Posts with likes sort before the others, so one top-n pass serves both cases. Only the n
    chosen posts' comment keys reach the comment scan.
    """
    fallback = F.when(F.col("like_count").isNull(), F.col("comment_count"))
    order = [F.desc_nulls_last("like_count"), F.desc_nulls_last(fallback), *newest_first()]
    best = linked_posts(c, _by_keyword(keyword)).orderBy(*order).limit(n)
    best = repeat_rows(
        best.withColumn("n_links", F.least("n_links", F.lit(n).cast("bigint"))), "n_links"
    ).orderBy(*order).limit(n)
    everything = Window.partitionBy(F.lit(1))  # at most n rows
    chosen = (
        best.withColumn("any_likes", F.max(F.col("like_count").isNotNull()).over(everything))
        .where(F.when(F.col("any_likes"), F.col("like_count").isNotNull())
               .otherwise(F.col("comment_count").isNotNull()))
    )
    bridge = c.videos.select(
        F.lit("bili").alias("platform"), F.col("bvid").alias("post_id"),
        F.col("aid").cast("string").alias("aid"),
    )
    keyed = chosen.join(bridge, ["platform", "post_id"], "left").withColumn(
        "comment_key", F.coalesce("aid", "post_id")
    )
    # Likes first, then the smallest id: the minimum of a struct, combined map-side.
    rank = F.struct(
        F.col("like_count").isNull().alias("none"), (-F.col("like_count")).alias("down"),
        "comment_id",
    )
    keys = keyed.select("platform", F.col("comment_key").alias("post_id")).distinct()
    comments = (
        c.comments.join(keys, ["platform", "post_id"], "left_semi")
        .groupBy("platform", F.col("post_id").alias("comment_key"))
        .agg(F.min_by(F.struct("author_name", "like_count", "content"), rank).alias("top"))
    )
    content = F.coalesce("content", F.lit(""))
    preview = F.substring(content, 1, 300)
    return (
        keyed.join(comments, ["platform", "comment_key"], "left")
        .select(
            "platform", "post_id", "url", F.coalesce("author_name", F.lit("?")).alias("author"),
            F.substring(F.coalesce("title", F.lit("(no title)")), 1, 120).alias("title"),
            F.coalesce("like_count", F.lit(0)).cast("bigint").alias("likes"),
            F.coalesce("comment_count", F.lit(0)).cast("bigint").alias("comments"),
            F.when(F.char_length(content) > 300, F.concat(preview, F.lit("…")))
            .otherwise(preview).alias("preview"),
            F.col("top.author_name").alias("top_comment_author"),
            F.coalesce("top.like_count", F.lit(0)).cast("bigint").alias("top_comment_likes"),
            F.substring("top.content", 1, 200).alias("top_comment"),
        )
        .orderBy(F.desc("likes"), F.desc("comments"), "platform", "post_id")
    )
