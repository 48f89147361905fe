"""Micropost platform payloads."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.functions.scalars import first_non_empty, lenient_int_variant
from hearsay.functions.text import strip_html
from hearsay.functions.times import parse_post_time
from hearsay.normalize.common import array_at, carried, each, get, is_set, parsed, raw, text
from hearsay.operators.chains import pages_by_cursor
from hearsay.operators.shared import top_k_per_key


# What is read of a card and of a post. A typed read gives all of it at once; a path read copies
# what it finds.
_CARD = "card_type:bigint,mblog:variant"
_CARDS = f"array<struct<{_CARD},card_group:array<struct<{_CARD}>>>>"

_POST = ("struct<id:string,mid:string,bid:string,user:struct<id:string,screen_name:string>,"
         "text:string,created_at:string,source:string,reposts_count:string,"
         "comments_count:string,attitudes_count:string,isLongText:string>")


def norm_cards(payloads: DataFrame, keys: Sequence[str] = ("keyword", "page_no")) -> DataFrame:
    """Posts (variant ``mblog``) of a search page's card tree, a card before its group."""
    cards = each(parsed(payloads), keys, get("v", "data.cards", _CARDS))
    own = F.struct("item.card_type", "item.mblog")
    family = F.concat(F.array(own), F.coalesce("item.card_group", F.array().cast(
        f"array<struct<{_CARD}>>")))
    members = cards.select(
        *keys, *carried(payloads), F.col("pos").alias("card"), F.posexplode(family).alias("member", "item")
    )
    mblog = F.col("item.mblog")
    return members.where(
        (F.col("item.card_type") == 9) & mblog.isNotNull() & ~F.is_variant_null(mblog)
    ).select(*keys, "card", "member", mblog.alias("mblog"), *carried(payloads))


def _as_of(as_of: Column | int) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def norm_micropost(
    posts: DataFrame, as_of: Column | int, keys: Sequence[str] = (),
    utc_offset_seconds: int = 0,
) -> DataFrame:
    """Post rows from a variant column ``mblog``; posts without an id are dropped.

    ``as_of`` is the fetch time, against which relative times are read.
    """
    # Every field is read once, in one read of the post; no filter can pass the generator and
    # read it again.
    post = posts.select("*", F.explode(F.array(get("mblog", "", _POST))).alias("_post"))

    def field(*names: str) -> Column:
        return first_non_empty(*[F.col(f"_post.{n}") for n in names])

    created = field("created_at")
    return post.select(
        *keys, field("id", "mid").alias("id"), field("bid").alias("mblogid"),
        field("user.id").alias("user_id"), field("user.screen_name").alias("user_name"),
        strip_html(field("text"), " ", strip=True).alias("text"),
        created.alias("created_at"),
        parse_post_time(created, _as_of(as_of), utc_offset_seconds).alias("created_ts"),
        field("source").alias("source"),
        *[lenient_int_variant(get("mblog", c, "variant"), F.col(f"_post.{c}")).alias(c)
          for c in ("reposts_count", "comments_count", "attitudes_count")],
        is_set(F.col("_post.isLongText")).alias("is_long"), raw("mblog").alias("raw"),
        *carried(posts),
    ).where(F.col("id") != "")


def long_text_override(posts: DataFrame, extended: DataFrame) -> DataFrame:
    """Replace the text of long posts by the full one from ``extended`` (id, body), where
    there is one."""
    full = parsed(extended).select(
        "id", strip_html(text("v", "data.longTextContent"), " ", strip=True).alias("full")
    )
    use = F.col("is_long") & (F.coalesce("full", F.lit("")) != "")
    return (
        posts.join(full, "id", "left")
        .withColumn("text", F.when(use, F.col("full")).otherwise(F.col("text")))
        .select(posts.columns)
    )


def hotflow_pages(payloads: DataFrame) -> DataFrame:
    """Comment pages (post_id, cursor, body) in reading order, with ``page_no``: every page names
    the ``max_id`` of the next; reading stops at a blocked page or one without comments."""
    pages = parsed(payloads)
    blocked = F.coalesce(get("v", "ok", "bigint"), F.lit(1)) == 0
    return pages_by_cursor(
        pages, ["post_id"], "cursor", F.nullif(get("v", "data.max_id"), F.lit("0")),
        empty=blocked | (F.size(array_at("v", "data.data")) == 0), first=("", "0"),
    ).drop("v")


def norm_hotflow(
    payloads: DataFrame, as_of: Column | int, max_count: int | None = None,
    utc_offset_seconds: int = 0,
) -> DataFrame:
    """Comment rows from comment pages (post_id, page_no, body), at most ``max_count`` per
    post in page order if given. Pages with ok = 0 count as blocked and give none."""
    open_pages = parsed(payloads).where(F.coalesce(get("v", "ok", "bigint"), F.lit(1)) != 0)
    rows = each(open_pages, ["post_id", "page_no"], array_at("v", "data.data"))
    created = text("item", "created_at")
    comments = rows.select(
        text("item", "id").alias("comment_id"), "post_id", "page_no", "pos",
        text("item", "user.id").alias("user_id"),
        text("item", "user.screen_name").alias("user_name"),
        strip_html(text("item", "text"), " ", strip=True).alias("text"),
        F.coalesce(get("item", "like_count", "bigint"), F.lit(0)).cast("bigint")
        .alias("like_count"),
        created.alias("created_at"),
        parse_post_time(created, _as_of(as_of), utc_offset_seconds).alias("created_ts"),
        raw("item").alias("raw"), *carried(payloads),
    ).where(F.col("comment_id") != "")
    if max_count is None:
        return comments.drop("page_no", "pos")
    first = top_k_per_key(comments, ["post_id"], [F.asc("page_no"), F.asc("pos")], max_count)
    return first.drop("page_no", "pos", "rank")


def snapshots(posts: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """Engagement snapshot rows of fetched posts."""
    none = F.lit(None).cast("bigint")
    return posts.select(
        F.lit("weibo").alias("platform"), F.col("id").alias("post_id"),
        F.col(fetched_at).alias("fetched_at"), none.alias("view_count"),
        F.col("attitudes_count").alias("like_count"),
        F.col("comments_count").alias("comment_count"), none.alias("favorite_count"),
        F.col("reposts_count").alias("share_count"),
    )
