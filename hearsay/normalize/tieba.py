"""Forum platform payloads and search pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.functions.scalars import URL_PREFIX, first_non_empty, lenient_int_variant
from hearsay.functions.markup import search_hits_of
from hearsay.functions.text import drop_tags, strip_html
from hearsay.normalize.common import (
    array_at, carried, each, epoch_or_null, first_of, get, pages_until_empty, parsed, raw, text, truthy,
)
from hearsay.operators.merge import first_wins

HIT_COLUMNS = ("tid title excerpt forum_name author_name author_id reply_num created_at "
               "created_ts").split()


def _int(value: str | Column, path: str) -> Column:
    return lenient_int_variant(get(value, path, "variant"))


def segments_to_text(content: Column) -> Column:
    """Text of a segment list (objects with a text, or strings) or of a plain string: joined
    by a space, tags dropped, trimmed."""
    def segment(s: Column) -> Column:
        kind = F.schema_of_variant(s)
        return F.when(kind.startswith("OBJECT"), get(s, "text")).when(
            kind == "STRING", get(s, "")
        )

    parts = F.filter(F.transform(get(content, "", "array<variant>"), segment),
                     lambda t: F.coalesce(t, F.lit("")) != "")
    joined = F.coalesce(F.array_join(parts, " "), get(content, ""), F.lit(""))
    return F.trim(drop_tags(joined), F.lit(" \t\n\r"))


def norm_forum_feed(payloads: DataFrame) -> DataFrame:
    """Thread hits of a forum's feed (keyword, page_no, body), pinned threads skipped, a
    thread once per keyword.

    Reading stops at the first page with an error, of a missing forum, or without threads.
    """
    pages = parsed(payloads).withColumns({
        "threads": array_at("v", "data.thread_list"),
        "forum_name": first_non_empty(get("v", "data.forum.name"), F.col("keyword")),
    })
    stop = (
        F.col("v").isNull() | (F.coalesce(get("v", "errno", "bigint"), F.lit(0)) != 0)
        | (F.coalesce(get("v", "data.forum.is_exists", "bigint"), F.lit(1)) == 0)
        | (F.size("threads") == 0)
    )
    kept = pages_until_empty(pages, ["keyword"], stop)
    rows = each(kept, ["keyword", "page_no", "forum_name"], F.col("threads"))
    hits = rows.where(~truthy("item", "is_top")).select(
        "keyword", "page_no", "pos", text("item", "tid", "id").alias("tid"),
        text("item", "title").alias("title"), text("item", "abstract").alias("excerpt"),
        "forum_name", text("item", "author.name", "author.name_show").alias("author_name"),
        text("item", "author.id").alias("author_id"),
        _int("item", "reply_num").alias("reply_num"),
        F.lit("").alias("created_at"),
        epoch_or_null(_int("item", "create_time")).alias("created_ts"),
    ).where(F.col("tid") != "")
    return first_wins(hits, ["keyword", "tid"], ["page_no", "pos"])


def _thread_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads (tid, body) with ``posts``, the post list; NULL ``v`` when unusable."""
    good = F.coalesce(get("v", "errno", "bigint"), F.lit(0)) == 0
    usable = parsed(payloads).withColumn("v", F.when(good, F.col("v")))
    listed = array_at("v", "data.post_list")
    other = array_at("v", "data.postList")
    return usable.select(
        "tid", "v", *carried(payloads), F.when(F.size(listed) > 0, listed).otherwise(other).alias("posts")
    )


def _replies() -> Column:
    """Posts after the first that have an id."""
    return F.filter(
        F.slice("posts", 2, F.greatest(F.size("posts") - 1, F.lit(0))),
        lambda p: text(p, "id", "post_id") != "",
    )


def norm_floors(payloads: DataFrame, max_replies: int | None = None) -> DataFrame:
    """Reply floors of thread payloads (tid, body): posts after the first that have an id, at
    most ``max_replies`` per thread if given."""
    first = first_of(_replies(), max_replies)
    rows = each(_thread_payloads(payloads), ["tid"], first)
    return rows.select(
        text("item", "id", "post_id").alias("pid"), "tid", _int("item", "floor").alias("floor"),
        text("item", "author.name", "author.name_show").alias("author_name"),
        text("item", "author.id", "author.portrait").alias("author_id"),
        segments_to_text(get("item", "content", "variant")).alias("content"),
        F.lit("").alias("created_at"),
        epoch_or_null(_int("item", "time")).alias("created_ts"), raw("item").alias("raw"),
        *carried(payloads),
    )


def norm_thread(
    hits: DataFrame, payloads: DataFrame, max_replies: int | None = None
) -> DataFrame:
    """Thread rows: detail payload first, search hit as the fallback for every field.

    A thread whose payload is missing or bad keeps its search metadata.
    """
    details = _thread_payloads(payloads).select(
        "tid", "v", *carried(payloads), F.get("posts", F.lit(0)).alias("op"),
        F.size(first_of(_replies(), max_replies)).cast("bigint").alias("kept"),
    )
    rows = hits.select(*HIT_COLUMNS).join(details, "tid", "left")
    has_op = F.col("op").isNotNull()

    def or_hit(column: str, *values: Column) -> Column:
        found = F.coalesce(*[F.nullif(v, F.lit("")) for v in values])
        return F.coalesce(F.when(has_op, found), F.col(column), F.lit(""))

    zero = F.lit(0).cast("bigint")
    replies = F.coalesce(
        epoch_or_null(_int("v", "data.thread.reply_num")),
        epoch_or_null(_int("v", "data.thread.replyNum")),
        epoch_or_null(F.col("reply_num")), F.col("kept"), zero,
    )
    created = F.coalesce(
        F.when(has_op, F.coalesce(
            epoch_or_null(_int("op", "time")),
            epoch_or_null(_int("v", "data.thread.create_time")))),
        F.col("created_ts"),
    )
    data = get("v", "data", "variant")
    return rows.select(
        "tid",
        or_hit("title", get("v", "data.thread.title"), get("op", "title")).alias("title"),
        or_hit("author_name", get("op", "author.name"), get("op", "author.name_show"))
        .alias("author_name"),
        or_hit("author_id", get("op", "author.id"), get("op", "author.portrait"))
        .alias("author_id"),
        F.coalesce(F.nullif(get("v", "data.forum.name"), F.lit("")), F.col("forum_name"),
                   F.lit("")).alias("forum_name"),
        or_hit("excerpt", segments_to_text(get("op", "content", "variant"))).alias("content"),
        replies.alias("reply_num"), F.coalesce("created_at", F.lit("")).alias("created_at"),
        created.alias("created_ts"),
        F.concat(F.lit(URL_PREFIX["tieba"]), "tid").alias("url"),
        F.coalesce(raw(data), F.to_json(F.struct(*HIT_COLUMNS))).alias("raw"), *carried(payloads),
    )


# Fixed value: the address of a thread.
_THREAD_HREF = r"""/p/(\d+)"""


def _inner(html: Column, sep: str = "") -> Column:
    """Text of inner HTML; the added tag makes entities count as markup."""
    return strip_html(F.concat(F.lit("<i>"), html), sep, strip=True)


def html_extract_links(
    pages: DataFrame, key: str, html: str, href: str = _THREAD_HREF
) -> DataFrame:
    """Links of a page whose address starts with ``href`` (its group is the id): (key, pos,
    tid, title), titled ones only, the first per id. Patterns alone, so it stays in the JVM; where
    links nest or hold images, :func:`hearsay.functions.markup.anchors_of` reads them all."""
    link = rf"""(?s)<a\b[^>]*\bhref=["']({href}[^"']*)["'][^>]*>.*?</a>"""
    found = pages.select(
        key, F.posexplode(F.regexp_extract_all(html, F.lit(link), 0)).alias("pos", "a")
    )
    ids = F.regexp_extract("a", rf"""\bhref=["']{href}""", 1)
    title = _inner(F.regexp_extract("a", r"(?s)^<a\b[^>]*>(.*)</a>$", 1))
    rows = found.select(key, "pos", ids.alias("tid"), title.alias("title"))
    return first_wins(rows.where(F.col("title") != ""), [key, "tid"], ["pos"])


def parse_search_html(pages: DataFrame) -> DataFrame:
    """Thread hits of result pages (page_id, html): from result blocks, or from all thread
    links of a page that has none."""
    hits = pages.select("page_id", F.posexplode(search_hits_of(F.col("html"))).alias("pos", "h"))
    return first_wins(hits.select("page_id", "pos", "h.*"), ["page_id", "tid"], ["pos"])


def snapshots(threads: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """Engagement snapshot rows of fetched threads."""
    none = F.lit(None).cast("bigint")
    return threads.select(
        F.lit("tieba").alias("platform"), F.col("tid").alias("post_id"),
        F.col(fetched_at).alias("fetched_at"), none.alias("view_count"),
        none.alias("like_count"), F.col("reply_num").alias("comment_count"),
        none.alias("favorite_count"), none.alias("share_count"),
    )
