"""Posts, answers and comments reached from a keyword, a run or an id."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from hearsay.functions.scalars import utc_text
from hearsay.operators.shared import SALTS, every_salt, repeat_rows, semi_join, top_k_per_key
from hearsay.operators.views import Tables, comments_unified, posts_unified
from hearsay.schema import RECORD_KINDS, TABLE_KEYS, unified_platforms


@dataclass(frozen=True)
class Corpus:
    """The inputs of the analytics: unified posts and comments, links, runs, id bridges."""

    posts: DataFrame
    comments: DataFrame
    links: DataFrame
    videos: DataFrame  # bvid, aid: bili comments hang off the aid
    answers: DataFrame  # id, question_id
    runs: DataFrame | None = None
    snapshots: DataFrame | None = None
    # Persist and count the key sets (links of a keyword or run) before joining them. Spark
    # then knows their true size: it broadcasts a small set, so posts and comments are not
    # shuffled at all, and falls back to the shuffled, salted joins for a large one.
    measure_keys: bool = False
    measured: list[DataFrame] = field(default_factory=list, compare=False)

    def keys(self, df: DataFrame) -> DataFrame:
        if self.measure_keys:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            df.count()
            self.measured.append(df)
        return df

    def release(self) -> None:
        """Drop the persisted key sets."""
        while self.measured:
            self.measured.pop().unpersist()

    @staticmethod
    def from_tables(tables: Tables, measure_keys: bool = False) -> "Corpus":
        return Corpus(
            measure_keys=measure_keys,
            posts=posts_unified(tables),
            comments=comments_unified(tables),
            links=tables["keyword_posts"],
            videos=tables["bili_videos"].select("bvid", "aid"),
            answers=tables["zhihu_answers"].select("id", "question_id"),
            runs=tables["scrape_runs"],
            snapshots=tables["engagement_snapshots"],
        )


def newest_first() -> list[Column]:
    # Ids break ties, so the range partitioning of the sort can split equal times.
    return [F.desc_nulls_last("published_at"), F.asc("platform"), F.asc("post_id")]


def most_liked_first() -> list[Column]:
    return [F.desc_nulls_last("like_count"), F.asc("platform"), F.asc("post_id"),
            F.asc("comment_id")]


def linked_posts(c: Corpus, where: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Posts joined to their links, one row per post (and ``by``), with ``n_links``.

    Links are counted per post before the join: a post linked by many runs moves once, and
    both join sides have unique keys.
    """
    links = c.links if where is None else c.links.where(where)
    counted = links.groupBy(*by, "platform", "post_id").agg(F.count(F.lit(1)).alias("n_links"))
    spread = counted.withColumn("platform", F.explode(unified_platforms(F.col("platform"))))
    return c.posts.join(c.keys(spread), ["platform", "post_id"])


def posts_for_keyword(
    c: Corpus, keyword: str, platforms: Sequence[str] | None = None,
    distinct_posts: bool = False, ordered: bool = True,
) -> DataFrame:
    """Posts brought in by a keyword, newest first; one row per link unless distinct."""
    where = F.col("keyword") == keyword
    if platforms:
        where = where & F.col("platform").isin(list(platforms))
    posts = linked_posts(c, where)
    posts = posts.drop("n_links") if distinct_posts else repeat_rows(posts, "n_links")
    return posts.orderBy(*newest_first()) if ordered else posts


def recent(posts: DataFrame, as_of: int, days: int) -> DataFrame:
    """Posts published within ``days`` before ``as_of`` (epoch seconds)."""
    return posts.where(F.col("published_at") >= as_of - days * 86400)


def answer_ids(c: Corpus, links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct ids of answers under linked questions, and ``by``.

    Answers are spread over salts: one question may own a large share of them.
    """
    questions = (
        links.where(F.col("platform") == "zhihu")
        .select(*by, F.col("post_id").alias("question_id")).distinct()
        .withColumn("_salt", every_salt())
    )
    answers = c.answers.select(
        F.col("id").cast("string").alias("post_id"),
        F.col("question_id").cast("string").alias("question_id"),
    ).withColumn("_salt", F.pmod(F.xxhash64("post_id"), F.lit(SALTS)))
    return answers.join(questions, ["question_id", "_salt"]).select(*by, "post_id")


def nested_answers(c: Corpus, links: DataFrame) -> DataFrame:
    """Answer posts under the questions of the given links."""
    answers = c.posts.where(F.col("platform") == "zhihu_answer")
    ids = c.keys(answer_ids(c, links))
    return answers.join(ids, "post_id", "left_semi").select(c.posts.columns)


def answers_for_keyword(c: Corpus, keyword: str, ordered: bool = True) -> DataFrame:
    """Answers under the questions a keyword brought in, most voted first."""
    out = nested_answers(c, c.links.where(F.col("keyword") == keyword))
    if not ordered:
        return out
    return out.orderBy(F.desc_nulls_last("like_count"), F.asc("post_id"))


def comment_keys(c: Corpus, links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (platform, post_id), and ``by``, under which comments of links are stored."""
    links = links.select(*by, "platform", "post_id").distinct()
    direct = links.where(F.col("platform").isin("weibo", "tieba"))
    videos = links.where(F.col("platform") == "bili").join(
        c.videos.select(F.col("bvid").alias("post_id"), "aid"), "post_id"
    ).select(*by, "platform", F.col("aid").cast("string").alias("post_id"))
    answers = answer_ids(c, links, by).select(
        *by, F.lit("zhihu_answer").alias("platform"), "post_id"
    )
    return direct.unionByName(videos).unionByName(answers).distinct()


def comments_under(c: Corpus, links: DataFrame) -> DataFrame:
    keys = c.keys(comment_keys(c, links))
    found = semi_join(c.comments, keys, ["platform", "post_id"], ["comment_id"])
    return found.select(c.comments.columns)


def comments_for_keyword(c: Corpus, keyword: str, ordered: bool = True) -> DataFrame:
    """Comments under everything a keyword brought in, most liked first."""
    out = comments_under(c, c.links.where(F.col("keyword") == keyword))
    return out.orderBy(*most_liked_first()) if ordered else out


def comments_for_post(c: Corpus, post_id: str, platform: str | None = None) -> DataFrame:
    """Comments of one post, most liked first. Without ``platform``, posts of several platforms
    that share the id count as one."""
    own = F.col("post_id") == post_id
    if platform is not None:
        own &= F.col("platform") == platform
    return c.comments.where(own).orderBy(*most_liked_first())


def run_post_keys(c: Corpus, links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(platform, post_id), and ``by``, of the posts of links, and then of the answers under their
    questions: an answer that is also linked itself is there twice."""
    direct = links.select(
        *by, F.explode(unified_platforms(F.col("platform"))).alias("platform"), "post_id"
    ).distinct()
    nested = answer_ids(c, links, by).distinct().select(
        *by, F.lit("zhihu_answer").alias("platform"), "post_id")
    return direct.unionByName(nested)


def posts_for_run(c: Corpus, run_id: int) -> DataFrame:
    """Posts of one run, followed by the answers under its questions. Both are found in one pass
    over the posts."""
    keys = run_post_keys(c, c.links.where(F.col("run_id") == run_id))
    return c.posts.join(c.keys(keys), ["platform", "post_id"]).select(c.posts.columns).orderBy(
        F.asc("platform"), F.desc_nulls_last("published_at"), F.asc("post_id")
    )


def run_comments(c: Corpus, run_id: int) -> DataFrame:
    """Comments of one run's posts, in no order."""
    return comments_under(c, c.links.where(F.col("run_id") == run_id))


def run_comments_order() -> list[Column]:
    return [F.asc("platform"), F.desc_nulls_last("like_count"), F.asc("comment_id")]


def comments_for_run(c: Corpus, run_id: int) -> DataFrame:
    """Comments of one run's posts."""
    return run_comments(c, run_id).orderBy(*run_comments_order())


def last_linked_posts(c: Corpus, n: int = 10, platform: str = "all") -> DataFrame:
    """The most recently linked posts; a link whose post is missing keeps a NULL title.

    The links are cut to ``n`` first, so only ``n`` titles are looked up.
    """
    links = c.links if platform == "all" else c.links.where(F.col("platform") == platform)
    order = [F.desc_nulls_last("fetched_at"), F.asc("keyword"), F.asc("platform"),
             F.asc("post_id"), F.asc("run_id")]
    last = links.orderBy(*order).limit(n).withColumn(
        "post_platform", unified_platforms(F.col("platform"), with_answers=False)[0]
    )
    titles = c.posts.select(F.col("platform").alias("post_platform"), "post_id", "title")
    return (
        last.join(titles, ["post_platform", "post_id"], "left")
        .orderBy(*order)
        .select("platform", "post_id", "title", "keyword", "run_id", "fetched_at")
    )


def record_lookup(tables: Tables, kind: str, record_id: str) -> DataFrame:
    """One record by kind and key; empty when unknown."""
    table = RECORD_KINDS[kind.lower()]
    key = TABLE_KEYS[table][0]
    wanted = F.lit(record_id).cast(tables[table].schema[key].dataType)
    return tables[table].where(F.col(key) == wanted)


def top_comments_per_post(comments: DataFrame, k: int) -> DataFrame:
    """The ``k`` most liked comments of every post, ranked."""
    order = [F.desc_nulls_last("like_count"), F.asc("comment_id")]
    return top_k_per_key(comments, ["platform", "post_id"], order, k)


def first_floors(replies: DataFrame, k: int) -> DataFrame:
    """The first ``k`` reply floors of every thread."""
    order = [F.asc_nulls_first("floor"), F.asc("comment_id")]
    return top_k_per_key(replies, ["post_id"], order, k)


def run_summary(runs: DataFrame, keyword: str | None = None) -> DataFrame:
    """Collection runs, newest first, with readable times."""
    runs = runs if keyword is None else runs.where(F.col("keyword") == keyword)
    return runs.select(
        "run_id", "keyword", "platform", "requested_count", "posts_fetched", "comments_fetched",
        utc_text(F.col("started_at")).alias("started"),
        utc_text(F.col("finished_at")).alias("finished"),
        "error",
    ).orderBy(F.desc("run_id"))


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` runs with duration and outcome."""
    return runs.select(
        "run_id", "keyword", "platform",
        F.coalesce("posts_fetched", F.lit(0)).cast("bigint").alias("posts_fetched"),
        F.coalesce("comments_fetched", F.lit(0)).cast("bigint").alias("comments_fetched"),
        utc_text(F.col("started_at")).alias("started"),
        F.coalesce(F.col("finished_at") - F.col("started_at"), F.lit(0)).cast("bigint")
        .alias("duration"),
        (F.coalesce(F.col("error"), F.lit("")) == "").alias("ok"),
        F.substring("error", 1, 120).alias("error"),
    ).orderBy(F.desc("run_id")).limit(n)
