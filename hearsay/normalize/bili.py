"""Video platform payloads."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from hearsay.normalize.common import (
    PAGE_BLOCK, array_at, carried, each, get, parsed, raw, text, truthy,
)
from hearsay.operators.chains import pages_by_cursor
from hearsay.operators.shared import running_total

STATS = ("view", "like", "coin", "favorite", "reply", "share", "danmaku")


def norm_video(payloads: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Video rows from detail payloads; ``tags`` (aid, tags) fills the tag list."""
    zero = F.lit(0).cast("bigint")
    rows = parsed(payloads).select(
        get("v", "data.bvid").alias("bvid"), get("v", "data.aid", "bigint").alias("aid"),
        get("v", "data.title").alias("title"), text("v", "data.desc").alias("desc"),
        get("v", "data.owner.mid", "bigint").alias("owner_mid"),
        get("v", "data.owner.name").alias("owner_name"),
        F.coalesce(get("v", "data.pubdate", "bigint"), zero).alias("pubdate"),
        F.coalesce(get("v", "data.duration", "bigint"), zero).alias("duration"),
        *[get("v", f"data.stat.{s}", "bigint").alias(s) for s in STATS],
        raw(get("v", "data", "variant")).alias("raw"), *carried(payloads),
    ).where(F.col("bvid").isNotNull())
    if tags is None:
        return rows.withColumn("tags", F.lit(None).cast("array<string>"))
    return rows.join(tags.select("aid", "tags"), "aid", "left")


def norm_tags(payloads: DataFrame) -> DataFrame:
    """(aid, tags) from tag payloads, empty names dropped."""
    names = F.transform(array_at("v", "data"), lambda t: get(t, "tag_name"))
    return parsed(payloads).select(
        "aid", F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "").alias("tags")
    )


def norm_comments(payloads: DataFrame) -> DataFrame:
    """Comment rows from reply pages (oid = the video's aid)."""
    rows = each(parsed(payloads), ["oid"], array_at("v", "data.replies"))
    return rows.select(
        get("item", "rpid", "bigint").alias("rpid"), "oid",
        F.coalesce(get("item", "parent", "bigint"), F.lit(0)).cast("bigint").alias("parent"),
        get("item", "mid", "bigint").alias("mid"),
        get("item", "member.uname").alias("uname"),
        get("item", "content.message").alias("message"),
        get("item", "ctime", "bigint").alias("ctime"),
        get("item", "like", "bigint").alias("likes"), raw("item").alias("raw"), *carried(payloads),
    )


def norm_user_videos(payloads: DataFrame) -> DataFrame:
    """Uploads of a user (mid) in page order."""
    rows = each(parsed(payloads), ["mid", "page_no"], array_at("v", "data.list.vlist"))
    return rows.select(
        "mid", "page_no", F.col("pos").cast("bigint").alias("pos"),
        get("item", "bvid").alias("bvid"), get("item", "aid", "bigint").alias("aid"),
        get("item", "title").alias("title"), get("item", "created", "bigint").alias("created"),
        get("item", "play", "bigint").alias("play"), raw("item").alias("raw"), *carried(payloads),
    )


def norm_dynamics(payloads: DataFrame) -> DataFrame:
    """Feed items; only those about a video have a bvid, whose title stands in for an
    empty text. Items without an id are dropped."""
    it = "item"
    rows = each(parsed(payloads), [], array_at("v", "data.items"))
    dynamic = "modules.module_dynamic"
    is_video = F.coalesce(get(it, f"{dynamic}.major.type"), F.lit("")) == "MAJOR_TYPE_ARCHIVE"
    title = F.when(is_video, get(it, f"{dynamic}.major.archive.title"))
    body = F.coalesce(
        F.nullif(get(it, f"{dynamic}.desc.text"), F.lit("")), title, F.lit("")
    )
    return rows.select(
        text(it, "id_str", "id").alias("dynamic_id"),
        get(it, "modules.module_author.mid", "bigint").alias("mid"),
        get(it, "modules.module_author.name").alias("uname"),
        get(it, "type").alias("type"), body.alias("text"),
        get(it, "modules.module_author.pub_ts", "bigint").alias("pub_ts"),
        *[get(it, f"modules.module_stat.{s}.count", "bigint").alias(f"{s}_count")
          for s in ("like", "comment", "forward")],
        F.when(is_video, get(it, f"{dynamic}.major.archive.bvid")).alias("bvid"),
        raw(it).alias("raw"), *carried(payloads),
    ).where(F.col("dynamic_id") != "")


def feed_pages(payloads: DataFrame, keys: Sequence[str] = ("mid",)) -> DataFrame:
    """Pages (keys, cursor, body) of activity feeds in reading order, with ``page_no``: every page
    names the next one's offset; reading stops at a page without items or that says it is the
    last."""
    pages = parsed(payloads)
    return pages_by_cursor(
        pages, keys, "cursor", get("v", "data.offset"),
        empty=F.size(array_at("v", "data.items")) == 0, ended=~truthy("v", "data.has_more"),
    ).drop("v")


def norm_search(payloads: DataFrame, keys: Sequence[str] = ("keyword",)) -> DataFrame:
    """Search hits with a rank that runs across the pages of a keyword.

    The videos are the first group of that type on a page. Ranks come from running page
    totals, so the hits themselves are never sorted or windowed.
    """
    groups = F.filter(array_at("v", "data.result"),
                      lambda g: get(g, "result_type") == "video")
    pages = parsed(payloads).select(
        *keys, "page_no", *carried(payloads), array_at(F.get(groups, F.lit(0)), "data").alias("videos")
    ).withColumn("n", F.size("videos").cast("bigint"))
    pages = running_total(pages, keys, "page_no", "n", PAGE_BLOCK, "through")
    rows = pages.select(
        *keys, *carried(payloads), (F.col("through") - F.col("n")).alias("before"),
        F.posexplode("videos").alias("pos", "item"),
    )
    marked = F.coalesce(get("item", "title"), F.lit(""))
    title = F.replace(F.replace(marked, F.lit('<em class="keyword">'), F.lit("")),
                      F.lit("</em>"), F.lit(""))
    return rows.select(
        *keys, get("item", "bvid").alias("bvid"), title.alias("title"),
        get("item", "author").alias("author"), get("item", "play", "bigint").alias("play"),
        (F.col("before") + F.col("pos") + 1).alias("rank"), raw("item").alias("raw"), *carried(payloads),
    )


def snapshots(videos: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """Engagement snapshot rows of fetched videos."""
    return videos.select(
        F.lit("bili").alias("platform"), F.col("bvid").alias("post_id"),
        F.col(fetched_at).alias("fetched_at"), F.col("view").alias("view_count"),
        F.col("like").alias("like_count"), F.col("reply").alias("comment_count"),
        F.col("favorite").alias("favorite_count"), F.col("share").alias("share_count"),
    )
