"""Cross-platform views: posts, comments, keyword links."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.functions.scalars import URL_PREFIX

Tables = Mapping[str, DataFrame]

# Unified column -> source column per platform; a missing entry is NULL.
_POSTS = {
    "bili": ("bili_videos", dict(
        post_id="bvid", author_id="owner_mid", author_name="owner_name", published_at="pubdate",
        title="title", content="desc", tags="tags", comment_count="reply", like_count="like",
        favorite_count="favorite", share_count="share", view_count="view")),
    "zhihu_question": ("zhihu_questions", dict(
        post_id="id", published_at="created", title="title", content="detail", tags="topics",
        comment_count="answer_count", favorite_count="follower_count",
        view_count="view_count")),
    "zhihu_answer": ("zhihu_answers", dict(
        post_id="id", author_id="author_id", author_name="author_name",
        published_at="created_time", content="content", comment_count="comment_count",
        like_count="voteup_count")),
    "weibo": ("weibo_posts", dict(
        post_id="id", author_id="user_id", author_name="user_name", published_at="created_ts",
        content="text", comment_count="comments_count", like_count="attitudes_count",
        share_count="reposts_count")),
    "tieba": ("tieba_threads", dict(
        post_id="tid", author_id="author_id", author_name="author_name",
        published_at="created_ts", title="title", content="content", tags="forum_name",
        comment_count="reply_num")),
}

_COMMENTS = {
    "bili": ("bili_comments", dict(
        post_id="oid", comment_id="rpid", author_id="mid", author_name="uname",
        published_at="ctime", content="message", like_count="likes")),
    "zhihu_answer": ("zhihu_answer_comments", dict(
        post_id="answer_id", comment_id="comment_id", author_id="author_id",
        author_name="author_name", published_at="created_time", content="content",
        like_count="like_count")),
    "weibo": ("weibo_comments", dict(
        post_id="post_id", comment_id="comment_id", author_id="user_id",
        author_name="user_name", published_at="created_ts", content="text",
        like_count="like_count")),
    "tieba": ("tieba_comments", dict(
        post_id="tid", comment_id="pid", author_id="author_id", author_name="author_name",
        published_at="created_ts", content="content")),
}

POST_COLUMNS = {
    "platform": "string", "post_id": "string", "url": "string", "author_id": "string",
    "author_name": "string", "published_at": "bigint", "title": "string", "content": "string",
    "tags": "string", "comment_count": "bigint", "like_count": "bigint",
    "favorite_count": "bigint", "share_count": "bigint", "view_count": "bigint",
    "fetched_at": "bigint",
}
COMMENT_COLUMNS = {
    "platform": "string", "post_id": "string", "comment_id": "string", "author_id": "string",
    "author_name": "string", "published_at": "bigint", "content": "string",
    "like_count": "bigint", "fetched_at": "bigint",
}


def post_url(platform: str, post_id: Column, question_id: Column | None = None) -> Column:
    """Public address of a post; NULL when an id is NULL."""
    if platform == "zhihu_answer":
        question = post_url("zhihu_question", question_id)
        return F.concat(question, F.lit("/answer/"), post_id)
    return F.concat(F.lit(URL_PREFIX[platform]), post_id.cast("string"))


def _branch(df: DataFrame, platform: str, mapping: dict, columns: dict) -> DataFrame:
    def value(name: str, kind: str) -> Column:
        if name == "platform":
            return F.lit(platform)
        if name == "url":
            question = F.col("question_id") if platform == "zhihu_answer" else None
            return post_url(platform, F.col(mapping["post_id"]), question)
        if name == "fetched_at":
            return F.col("fetched_at").cast(kind)
        source = mapping.get(name)
        return (F.col(source) if source else F.lit(None)).cast(kind)

    return df.select([value(n, k).alias(n) for n, k in columns.items()])


def _union(tables: Tables, branches: dict, columns: dict) -> DataFrame:
    out = None
    for platform, (table, mapping) in branches.items():
        part = _branch(tables[table], platform, mapping, columns)
        out = part if out is None else out.unionByName(part)
    return out


def posts_unified(tables: Tables) -> DataFrame:
    """Posts of all platforms in one shape. Filters and column choices made on the result
    reach each table's scan."""
    return _union(tables, _POSTS, POST_COLUMNS)


def comments_unified(tables: Tables) -> DataFrame:
    """Comments of all platforms in one shape; bili comments carry the video's aid."""
    return _union(tables, _COMMENTS, COMMENT_COLUMNS)


def keyword_posts_unified(links: DataFrame, runs: DataFrame) -> DataFrame:
    """Keyword links with the start time of their run; links without a run stay."""
    started = runs.select("run_id", F.col("started_at").alias("run_started_at"))
    return links.join(started, "run_id", "left").select(
        "keyword", "platform", "post_id", "run_id", "rank", "run_started_at"
    )


def create_views(tables: Tables) -> None:
    """Register the three views for SQL use."""
    posts_unified(tables).createOrReplaceTempView("posts_unified")
    comments_unified(tables).createOrReplaceTempView("comments_unified")
    keyword_posts_unified(
        tables["keyword_posts"], tables["scrape_runs"]
    ).createOrReplaceTempView("keyword_posts_unified")
