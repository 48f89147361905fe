"""Question-and-answer platform payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.functions.scalars import first_present
from hearsay.functions.text import strip_html
from hearsay.normalize.common import (
    array_at, carried, each, first_of, get, parsed, raw, text,
)

# Fixed value: where a rendered page keeps its data.
STATE_REGEX = r'(?s)<script[^>]*id="js-initialData"[^>]*>(.+?)</script>'


def _lines(value: Column | str, *paths: str) -> Column:
    return strip_html(text(value, *paths), "\n", strip=True)


def topic_names(topics: Column, named: Column | None = None) -> Column:
    """Names of a topic list: an object's name or title, a bare id looked up in the map
    ``named`` or kept as text. NULL when there are none."""
    def name(t: Column) -> Column:
        bare = get(t, "")
        if named is not None:
            known = get(F.try_element_at(named, bare), "name")
            bare = F.coalesce(F.nullif(known, F.lit("")), bare)
        titled = F.coalesce(F.nullif(get(t, "name"), F.lit("")), get(t, "title"))
        return F.when(F.schema_of_variant(t).startswith("OBJECT"), titled).otherwise(bare)

    names = F.filter(F.transform(topics, name), lambda n: F.coalesce(n, F.lit("")) != "")
    return F.when(F.size(names) > 0, names)


def norm_question(payloads: DataFrame) -> DataFrame:
    """Question rows from detail payloads (question_id, body)."""
    return parsed(payloads).where(F.col("v").isNotNull()).select(
        F.coalesce(get("v", "id", "bigint"), F.col("question_id")).alias("id"),
        get("v", "title").alias("title"), _lines("v", "detail").alias("detail"),
        get("v", "answer_count", "bigint").alias("answer_count"),
        get("v", "follower_count", "bigint").alias("follower_count"),
        get("v", "visit_count", "bigint").alias("view_count"),
        get("v", "created", "bigint").alias("created"),
        topic_names(array_at("v", "topics")).alias("topics"), raw("v").alias("raw"),
        *carried(payloads),
    )


def norm_answers(payloads: DataFrame) -> DataFrame:
    """Answer rows from answer pages (question_id, body)."""
    rows = each(parsed(payloads), ["question_id"], array_at("v", "data"))
    return rows.select(
        get("item", "id", "bigint").alias("id"), "question_id",
        get("item", "author.id").alias("author_id"),
        get("item", "author.name").alias("author_name"),
        *[get("item", c, "bigint").alias(c)
          for c in ("voteup_count", "comment_count", "created_time", "updated_time")],
        _lines("item", "content").alias("content"), raw("item").alias("raw"),
        *carried(payloads),
    ).where(F.col("id").isNotNull())


def norm_general_search(payloads: DataFrame) -> DataFrame:
    """Flat search hits (keyword, page_no, body) with the parent question of answers."""
    rows = each(parsed(payloads), ["keyword", "page_no"], array_at("v", "data"))
    kind = text("item", "object.type", "type")
    return rows.select(
        "keyword", "page_no", F.col("pos").cast("bigint").alias("pos"),
        F.when(kind != "", kind).otherwise("unknown").alias("kind"),
        text("item", "object.id", "id").alias("target_id"),
        text("item", "object.title", "object.question.title", "object.name").alias("title"),
        _lines("item", "object.excerpt", "object.excerpt_new").alias("excerpt"),
        get("item", "object.question.id").alias("parent_id"), raw("item").alias("raw"),
        *carried(payloads),
    )


def _article(v: str, column_id: Column) -> list[Column]:
    return [
        get(v, "id", "bigint").alias("id"),
        F.coalesce(F.nullif(column_id, F.lit("")), get(v, "column.id")).alias("column_id"),
        get(v, "title").alias("title"), get(v, "author.id").alias("author_id"),
        get(v, "author.name").alias("author_name"),
        *[get(v, c, "bigint").alias(c)
          for c in ("voteup_count", "comment_count", "created", "updated")],
        _lines(v, "excerpt").alias("excerpt"), _lines(v, "content").alias("content"),
        raw(v).alias("raw"),
    ]


def norm_article(payloads: DataFrame) -> DataFrame:
    """Article rows from single-article payloads."""
    return parsed(payloads).select(
        *_article("v", F.lit(None).cast("string")), *carried(payloads)).where(
        F.col("id").isNotNull()
    )


def norm_column_items(payloads: DataFrame) -> DataFrame:
    """Article rows from column listing pages (column_id, body)."""
    rows = each(parsed(payloads), ["column_id"], array_at("v", "data"))
    return rows.select(
        *_article("item", F.col("column_id")), *carried(payloads)).where(F.col("id").isNotNull())


def norm_column(payloads: DataFrame) -> DataFrame:
    """Column rows from detail payloads (column_id, body)."""
    return parsed(payloads).where(F.col("v").isNotNull()).select(
        F.coalesce(F.nullif(get("v", "id"), F.lit("")), F.col("column_id")).alias("id"),
        get("v", "title").alias("title"), get("v", "author.id").alias("author_id"),
        get("v", "author.name").alias("author_name"),
        _lines("v", "description").alias("description"),
        *[get("v", c, "bigint").alias(c)
          for c in ("articles_count", "followers", "created", "updated")],
        raw("v").alias("raw"),
        *carried(payloads),
    )


def norm_answer_comments(
    payloads: DataFrame, max_comments: int | None = None, zero_is_missing: bool = False
) -> DataFrame:
    """The comments of each answer payload (answer_id, body), the first ones if capped."""
    first = first_of(array_at("v", "data"), max_comments)
    rows = each(parsed(payloads), ["answer_id"], first)
    likes = first_present(
        get("item", "like_count", "bigint"), get("item", "vote_count", "bigint"),
        zero_is_missing=zero_is_missing,
    )
    return rows.select(
        get("item", "id", "bigint").alias("comment_id"), "answer_id",
        get("item", "author.id").alias("author_id"),
        get("item", "author.name").alias("author_name"),
        _lines("item", "content").alias("content"), likes.alias("like_count"),
        get("item", "created_time", "bigint").alias("created_time"), raw("item").alias("raw"),
        *carried(payloads),
    ).where(F.col("comment_id").isNotNull())


def _entities(pages: DataFrame) -> DataFrame:
    """Pages (question_id, html) with the entity maps of their embedded state, in page order."""
    entity = "map<string,variant>"
    state = F.from_json(
        F.nullif(F.regexp_extract("html", STATE_REGEX, 1), F.lit("")),
        f"initialState struct<entities: struct<questions: {entity}, answers: {entity}, "
        f"topics: {entity}>>",
    )
    return pages.select("question_id", *carried(pages), state.alias("s")).select(
        "question_id", *carried(pages), "s.initialState.entities.*"
    )


def _first(v: str, kind: str, *paths: str, zero_is_missing: bool) -> Column:
    return first_present(*[get(v, p, kind) for p in paths], zero_is_missing=zero_is_missing)


def embedded_questions(pages: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """Question rows from rendered pages (question_id, html)."""
    def count(camel: str, snake: str) -> Column:
        return _first("q", "bigint", camel, snake, zero_is_missing=zero_is_missing)

    # A filter on the question would be pushed below the parser and read every page again.
    own = F.array(F.try_element_at("questions", F.col("question_id").cast("string")))
    found = _entities(pages).select(
        "question_id", "topics", *carried(pages),
        F.explode(F.filter(own, lambda q: q.isNotNull())).alias("q"),
    )
    listed = F.when(F.size(array_at("q", "topics")) > 0, array_at("q", "topics")).otherwise(
        array_at("q", "topicIds")
    )
    known = F.coalesce("topics", F.create_map().cast("map<string,variant>"))
    return found.select(
        F.coalesce(get("q", "id", "bigint"), F.col("question_id")).alias("id"),
        get("q", "title").alias("title"), _lines("q", "detail").alias("detail"),
        count("answerCount", "answer_count").alias("answer_count"),
        count("followerCount", "follower_count").alias("follower_count"),
        count("visitCount", "visit_count").alias("view_count"),
        get("q", "created", "bigint").alias("created"),
        topic_names(listed, known).alias("topics"), raw("q").alias("raw"), *carried(pages),
    )


def embedded_answers(
    pages: DataFrame, max_answers: int | None = None, zero_is_missing: bool = False
) -> DataFrame:
    """The answers of each rendered page to the page's own question, the most voted if capped."""
    def count(camel: str, snake: str) -> Column:
        return _first("a", "bigint", camel, snake, zero_is_missing=zero_is_missing)

    own = F.filter(
        F.coalesce(F.map_values("answers"), F.array().cast("array<variant>")),
        lambda a: get(a, "question.id") == F.col("question_id").cast("string"),
    )
    listed = _entities(pages).select("question_id", *carried(pages), own.alias("own"))
    order = F.array_sort(F.transform("own", lambda a, i: F.struct(
        (-F.coalesce(get(a, "voteupCount", "bigint"), F.lit(0))).alias("down"), i.alias("i"))))
    best = listed.select(
        "question_id", *carried(pages), "own", F.explode(first_of(order, max_answers)).alias("o")
    ).select("question_id", *carried(pages), F.get("own", F.col("o.i")).alias("a"))
    return best.select(
        get("a", "id", "bigint").alias("id"), "question_id",
        get("a", "author.id").alias("author_id"), get("a", "author.name").alias("author_name"),
        count("voteupCount", "voteup_count").alias("voteup_count"),
        count("commentCount", "comment_count").alias("comment_count"),
        count("createdTime", "created_time").alias("created_time"),
        count("updatedTime", "updated_time").alias("updated_time"),
        _lines("a", "content").alias("content"), raw("a").alias("raw"), *carried(pages),
    ).where(F.col("id").isNotNull())


def snapshots(questions: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """Engagement snapshot rows of fetched questions."""
    none = F.lit(None).cast("bigint")
    return questions.select(
        F.lit("zhihu_question").alias("platform"), F.col("id").cast("string").alias("post_id"),
        F.col(fetched_at).alias("fetched_at"), "view_count", none.alias("like_count"),
        F.col("answer_count").alias("comment_count"),
        F.col("follower_count").alias("favorite_count"), none.alias("share_count"),
    )
