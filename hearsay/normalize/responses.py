"""What a response means: usable, or why not."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearsay.normalize.common import array_at, get, parsed
from hearsay.normalize.zhihu import STATE_REGEX

# Response codes.
LOGIN_EXPIRED = (100, 401001, 100200000)
SOFT_BLOCK = (10003, 40362, 1003)
BLOCKED_STATUS = {"weibo": (403, 418, 432), "tieba": (403, 418, 412)}
HTML_ENDPOINTS = ("page", "html_search")


def classify(
    payloads: DataFrame, other: str = "OtherError", keep_parsed: bool = False
) -> DataFrame:
    """Payloads with ``outcome``: OK, RateLimited, SoftBanned, AuthRequired, CookieExpired,
    NotFound, ParseError, or ``other`` for any other failure.

    Needs platform, endpoint, page_no, status, has_cookie, body. A first search page without
    hits is a soft block, not a miss. ``keep_parsed`` leaves the body as a variant in ``v``.
    """
    platform, endpoint = F.col("platform"), F.col("endpoint")
    status, cookie = F.col("status"), F.coalesce("has_cookie", F.lit(False))
    is_search = endpoint == "search"
    first_page = F.col("page_no") == 1

    blocked = F.lit(False)
    for name, codes in BLOCKED_STATUS.items():
        blocked = blocked | ((platform == name) & status.isin(*codes))
    code = get("v", "code", "bigint")
    error_code = get("v", "error.code", "bigint")
    ok = get("v", "ok", "bigint")
    groups = F.filter(array_at("v", "data.result"), lambda g: get(g, "result_type") == "video")
    no_videos = F.size(array_at(F.get(groups, F.lit(0)), "data")) == 0
    no_cards = F.size(array_at("v", "data.cards")) == 0
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    is_html = endpoint.isin(*HTML_ENDPOINTS)
    expired_or_missing = F.when(cookie, "CookieExpired").otherwise("AuthRequired")

    bili = (
        F.when(code.isin(-404, -400), "NotFound").when(code == -101, expired_or_missing)
        .when(code == -111, "AuthRequired").when(code == -352, "SoftBanned")
        .when(F.coalesce(code, F.lit(-1)) != 0, other)
        .when(is_search & first_page & no_videos, "SoftBanned")
    )
    zhihu = F.when(
        is_search & first_page & (F.size(array_at("v", "data")) == 0), "SoftBanned"
    )
    weibo = (
        F.when(is_search & first_page & no_cards & (F.coalesce(ok, F.lit(0)) != 1) & ~cookie,
               "AuthRequired")
        .when(is_search & first_page & no_cards, "SoftBanned")
        .when((endpoint == "status") & (ok == 0), "NotFound")
    )
    tieba = F.when(
        (endpoint == "thread") & (F.coalesce(get("v", "errno", "bigint"), F.lit(0)) != 0),
        "ParseError",
    )
    page = F.when(
        (endpoint == "page") & ~F.col("body").rlike(STATE_REGEX), "ParseError"
    ).when(
        (endpoint == "html_search") & first_page & ~F.col("body").rlike(r"/p/\d+"), "SoftBanned"
    )
    outcome = (
        F.when(blocked, "SoftBanned").when(status.isin(429, 412), "RateLimited")
        .when((platform == "zhihu") & (status >= 400) & error_code.isin(*LOGIN_EXPIRED),
              "CookieExpired")
        .when((platform == "zhihu") & (status >= 400) & error_code.isin(*SOFT_BLOCK),
              "SoftBanned")
        .when((platform == "zhihu") & status.isin(401, 403), "AuthRequired")
        .when((platform == "zhihu") & (status == 404), "NotFound")
        .when(status >= 400, other)
        .when(is_html, page)
        .when(~is_object, "ParseError")
        .when(platform == "bili", bili).when(platform == "zhihu", zhihu)
        .when(platform == "weibo", weibo).when(platform == "tieba", tieba)
    )
    classed = parsed(payloads).withColumn("outcome", F.coalesce(outcome, F.lit("OK")))
    return classed if keep_parsed else classed.drop("v")


def response_classes(payloads: DataFrame) -> DataFrame:
    """Responses per platform, endpoint and outcome."""
    return (
        classify(payloads).groupBy("platform", "endpoint", "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
    )
