"""The data model: typed tables, their keys, the unified column names, the platform map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Table and column names users of the data model query by.
# A column is a string unless listed in _LONG; lists and payloads are JSON text.
_COLUMNS = {
    "bili_videos": "bvid aid title desc owner_mid owner_name pubdate duration view like coin "
    "favorite reply share danmaku tags raw fetched_at",
    "bili_comments": "rpid oid parent mid uname message ctime likes raw fetched_at",
    "bili_dynamics": "dynamic_id mid uname type text pub_ts like_count comment_count "
    "forward_count bvid raw fetched_at",
    "bili_search": "keyword bvid title author play rank raw fetched_at",
    "zhihu_questions": "id title detail answer_count follower_count view_count created topics "
    "raw fetched_at",
    "zhihu_answers": "id question_id author_id author_name voteup_count comment_count "
    "created_time updated_time content raw fetched_at",
    "zhihu_columns": "id title author_id author_name description articles_count followers "
    "created updated raw fetched_at",
    "zhihu_articles": "id column_id title author_id author_name voteup_count comment_count "
    "created updated excerpt content raw fetched_at",
    "zhihu_search": "keyword kind target_id title excerpt raw fetched_at",
    "scrape_runs": "run_id keyword platform requested_count started_at finished_at "
    "posts_fetched comments_fetched config error",
    "keyword_posts": "keyword platform post_id run_id rank fetched_at",
    "engagement_snapshots": "platform post_id fetched_at view_count like_count comment_count "
    "favorite_count share_count",
    "zhihu_answer_comments": "comment_id answer_id author_id author_name content like_count "
    "created_time raw fetched_at",
    "weibo_posts": "id mblogid user_id user_name text created_at created_ts source "
    "reposts_count comments_count attitudes_count raw fetched_at",
    "weibo_comments": "comment_id post_id user_id user_name text like_count created_at "
    "created_ts raw fetched_at",
    "tieba_threads": "tid title author_name author_id forum_name content reply_num created_at "
    "created_ts url raw fetched_at",
    "tieba_comments": "pid tid floor author_name author_id content created_at created_ts raw "
    "fetched_at",
}

_LONG = {
    "bili_videos": "aid owner_mid pubdate duration view like coin favorite reply share danmaku "
    "fetched_at",
    "bili_comments": "rpid oid parent mid ctime likes fetched_at",
    "bili_dynamics": "mid pub_ts like_count comment_count forward_count fetched_at",
    "bili_search": "play rank fetched_at",
    "zhihu_questions": "id answer_count follower_count view_count created fetched_at",
    "zhihu_answers": "id question_id voteup_count comment_count created_time updated_time "
    "fetched_at",
    "zhihu_columns": "articles_count followers created updated fetched_at",
    "zhihu_articles": "id voteup_count comment_count created updated fetched_at",
    "zhihu_search": "fetched_at",
    "scrape_runs": "run_id requested_count started_at finished_at posts_fetched "
    "comments_fetched",
    "keyword_posts": "run_id rank fetched_at",
    "engagement_snapshots": "fetched_at view_count like_count comment_count favorite_count "
    "share_count",
    "zhihu_answer_comments": "comment_id answer_id like_count created_time fetched_at",
    "weibo_posts": "created_ts reposts_count comments_count attitudes_count fetched_at",
    "weibo_comments": "like_count created_ts fetched_at",
    "tieba_threads": "reply_num created_ts fetched_at",
    "tieba_comments": "floor created_ts fetched_at",
}

TABLE_KEYS: dict[str, tuple[str, ...]] = {
    "bili_videos": ("bvid",),
    "bili_comments": ("rpid",),
    "bili_dynamics": ("dynamic_id",),
    "bili_search": ("keyword", "bvid"),
    "zhihu_questions": ("id",),
    "zhihu_answers": ("id",),
    "zhihu_columns": ("id",),
    "zhihu_articles": ("id",),
    "zhihu_search": ("keyword", "kind", "target_id"),
    "scrape_runs": ("run_id",),
    "keyword_posts": ("keyword", "platform", "post_id", "run_id"),
    "engagement_snapshots": ("platform", "post_id", "fetched_at"),
    "zhihu_answer_comments": ("comment_id",),
    "weibo_posts": ("id",),
    "weibo_comments": ("comment_id",),
    "tieba_threads": ("tid",),
    "tieba_comments": ("pid",),
}

# Record kind -> table, for single-record lookup (the key is the table's only key column).
RECORD_KINDS = {
    "video": "bili_videos",
    "dynamic": "bili_dynamics",
    "question": "zhihu_questions",
    "answer": "zhihu_answers",
    "article": "zhihu_articles",
    "column": "zhihu_columns",
    "comment": "zhihu_answer_comments",
    "weibo": "weibo_posts",
    "thread": "tieba_threads",
}

PLATFORMS = ("bili", "zhihu_question", "zhihu_answer", "weibo", "tieba")

# Internal English column -> name in exports.
ZH_NAMES = {
    "platform": "平台",
    "post_id": "帖子ID",
    "url": "笔记链接",
    "author_id": "作者ID",
    "author_name": "作者昵称",
    "published_at": "发布时间",
    "title": "标题",
    "content": "内容",
    "tags": "标签",
    "comment_count": "评论数量",
    "like_count": "点赞数量",
    "favorite_count": "收藏数量",
    "share_count": "转发数量",
    "view_count": "播放数量",
    "fetched_at": "抓取时间",
    "comment_id": "评论ID",
    "keyword": "关键词",
    "run_id": "运行ID",
    "rank": "排名",
    "run_started_at": "运行开始时间",
    "day": "日期",
    "snapshot_time": "时间",
    "n_posts": "帖子数",
    "total_comments": "评论总数",
    "total_likes": "点赞总数",
    "total_favorites": "收藏总数",
    "total_views": "播放总数",
    "requested_count": "请求数量",
    "posts_fetched": "实际帖子数",
    "comments_fetched": "实际评论数",
    "started": "开始时间",
    "finished": "结束时间",
    "error": "错误信息",
    "source": "类型",
    "text": "文本",
    "score": "情感得分",
    "label": "情感标签",
    "pos_hits": "正面词数",
    "neg_hits": "负面词数",
    "n": "样本数",
    "pos": "正面",
    "neu": "中性",
    "neg": "负面",
    "pos_share": "正面占比",
    "neg_share": "负面占比",
    "mean_score": "平均情感得分",
    "tendency": "情感倾向",
    "word": "词",
    "weight": "权重",
}
ZH_LABELS = {"pos": "正面", "neu": "中性", "neg": "负面"}
ZH_SOURCES = {"post": "帖子", "answer": "回答", "comment": "评论"}


def table_schema(table: str) -> StructType:
    """Spark schema of a table."""
    longs = set(_LONG[table].split())
    return StructType(
        [
            StructField(c, LongType() if c in longs else StringType())
            for c in _COLUMNS[table].split()
        ]
    )


SCHEMAS: dict[str, StructType] = {t: table_schema(t) for t in _COLUMNS}


def to_zh(df: DataFrame) -> DataFrame:
    """Rename to the exported names and translate the values of label and source."""
    for column, names in (("label", ZH_LABELS), ("tendency", ZH_LABELS), ("source", ZH_SOURCES)):
        if column in df.columns:
            df = df.replace(names, subset=[column])
    return df.withColumnsRenamed({c: ZH_NAMES[c] for c in df.columns if c in ZH_NAMES})


def unified_platforms(link_platform: Column, with_answers: bool = True) -> Column:
    """Array of the unified platforms a link's platform stands for.

    Links know one "zhihu"; posts split it in two. A narrow array expression instead of a
    join or an OR condition, so a link finds its posts by equality.
    """
    zhihu = ["zhihu_question", "zhihu_answer"] if with_answers else ["zhihu_question"]
    return F.when(link_platform == "zhihu", F.array(*map(F.lit, zhihu))).otherwise(
        F.array(link_platform)
    )
