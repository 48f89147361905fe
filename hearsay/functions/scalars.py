"""Small column expressions. None depends on the session time zone."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, functions as F

# URL prefixes of the unified views.
URL_PREFIX = {
    "bili": "https://www.bilibili.com/video/",
    "zhihu_question": "https://www.zhihu.com/question/",
    "weibo": "https://m.weibo.cn/detail/",
    "tieba": "https://tieba.baidu.com/p/",
}

# Link shapes in matching order; an answer link contains a question link.
URL_PATTERNS = [
    (r"(?i)bilibili\.com/video/(BV[0-9A-Za-z]+)", "bili_video"),
    (r"zhihu\.com/question/(\d+)/answer/(\d+)", "zhihu_answer"),
    (r"zhihu\.com/question/(\d+)", "zhihu_question"),
    (r"zhuanlan\.zhihu\.com/p/(\d+)", "zhihu_article"),
    (r"zhuanlan\.zhihu\.com/(c_[0-9a-zA-Z]+)", "zhihu_column"),
    (r"(?:m\.)?weibo\.c(?:n|om)/(?:detail|status|u/status)/(\d+)", "weibo_post"),
    (r"weibo\.com/\d+/([A-Za-z][A-Za-z0-9]+)", "weibo_post"),
    (r"tieba\.baidu\.com/p/(\d+)", "tieba_thread"),
]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it. A Column
    is a tree: written out, every mention is computed again, and nested ones multiply."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def utc_day(epoch: Column) -> Column:
    """Epoch seconds -> 'yyyy-MM-dd' in UTC."""
    days = F.floor(epoch / 86400).try_cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")


def utc_text(epoch: Column) -> Column:
    """Epoch seconds -> 'yyyy-MM-dd HH:mm:ss' in UTC."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), epoch)).cast("string")


def lenient_int(text: Column) -> Column:
    """Digits-only text -> bigint; anything else (signs, decimals, words, NULL) -> 0."""
    number = once(F.trim(text), lambda t: F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint")))
    return F.coalesce(number, F.lit(0).cast("bigint"))


def lenient_int_variant(value: Column, text: Column | None = None) -> Column:
    """The same for a JSON value, whose type decides: integers stay, decimals are cut,
    digit strings are read, booleans and the rest become 0. ``text`` is the value as text, if it
    was read already."""
    def typed(value: Column, kind: Column) -> Column:
        return F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint")).when(
            kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"),
            F.try_variant_get(value, "$", "double").try_cast("bigint"),
        )

    # Digits are read alike from a number and a string, and what no number looks like is 0: few
    # values are left whose type must be known.
    def read(value: Column, t: Column) -> Column:
        return F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint")).when(
            t.rlike("^[-+.0-9Ee]+$"),
            once(value, lambda v: once(F.schema_of_variant(v), lambda kind: typed(v, kind))))

    if text is None:
        found = once(value, lambda v: once(
            F.trim(F.try_variant_get(v, "$", "string")), lambda t: read(v, t)))
    else:
        found = read(value, F.trim(text))
    return F.coalesce(found, F.lit(0).cast("bigint"))


def first_present(*columns: Column, zero_is_missing: bool = False) -> Column:
    """First non-NULL value; with ``zero_is_missing`` a 0 yields to all but the last column."""
    if zero_is_missing:
        columns = tuple(F.nullif(c, F.lit(0)) for c in columns[:-1]) + columns[-1:]
    return F.coalesce(*columns)


def first_non_empty(*columns: Column) -> Column:
    """First column that is neither NULL nor ''; '' when none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def shorten(text: Column, n: int) -> Column:
    """Cut to ``n`` characters, the last being an ellipsis when something was cut."""
    cut = F.concat(F.substring(text, 1, n - 1), F.lit("…"))
    return F.when(F.char_length(text) > n, cut).otherwise(text)


def percent(share: Column) -> Column:
    """0.125 -> '12.5%'."""
    return F.format_string("%.1f%%", share * 100)


def row_text(*columns: Column) -> Column:
    """Trimmed cells joined by a space; NULL, blank and the literal 'nan' are skipped."""
    cells = []
    for c in columns:
        cell = F.trim(c.cast("string"), F.lit(" \t\n\r\f\x0b"))
        cells.append(F.when((cell != "") & (F.lower(cell) != "nan"), cell))
    return F.concat_ws(" ", *cells)


def sanitize_keyword(keyword: Column) -> Column:
    """A keyword as a file or partition name: letters, digits and '_-.', at most 80."""
    kept = F.substring(F.regexp_replace(keyword, r"[^\p{L}\p{N}_.\-]", ""), 1, 80)
    return F.when(kept != "", kept).otherwise(F.lit("keyword"))


def classify_url(url: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """struct(kind, id, id2) by the first matching pattern; NULL fields when none matches."""
    trimmed = F.trim(url)
    kind = first = second = None
    for regex, name in patterns if patterns is not None else URL_PATTERNS:
        groups = regex.replace(r"(?:", "").replace("(?i)", "").count("(")
        hit = F.regexp_like(trimmed, F.lit(regex))
        id1 = F.regexp_extract(trimmed, regex, 1) if groups else F.lit(None).cast("string")
        id2 = F.regexp_extract(trimmed, regex, 2) if groups > 1 else F.lit(None).cast("string")
        kind = F.when(hit, F.lit(name)) if kind is None else kind.when(hit, F.lit(name))
        first = F.when(hit, id1) if first is None else first.when(hit, id1)
        second = F.when(hit, id2) if second is None else second.when(hit, id2)
    return F.struct(kind.alias("kind"), first.alias("id"), second.alias("id2"))


def classify_id(post_id: Column) -> Column:
    """Platform kind told by the shape of an id, NULL when unknown."""
    trimmed = F.trim(post_id)
    video = F.upper(trimmed).startswith("BV") & (F.char_length(trimmed) >= 10)
    return F.when(video, "bili_video").when(trimmed.rlike("^[0-9]+$"), "zhihu_question")
