"""Relative, partial and zoned post times -> epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearsay.functions.scalars import once

# Spellings the platforms use.
JUST_NOW = "刚刚"
MINUTES_AGO = r"(\d+)\s*分钟前"
HOURS_AGO = r"(\d+)\s*小时前"
YESTERDAY = "昨天"
ZONED = (
    r"(?i)^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+"
    r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})\s+"
    r"(\d{1,2}):(\d{1,2}):(\d{1,2})\s+([+-])(\d{2}):?(\d{2})\s+(\d{4})$"
)
YEAR_MONTH_DAY = (
    r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$"
)
MONTH_DAY = r"^(\d{1,2})-(\d{1,2})(?:\s+(\d{1,2}):(\d{1,2}))?$"
CLOCK = r"^(\d{1,2}):(\d{1,2})$"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _number(text: Column, regex: str, group: int) -> Column:
    return F.regexp_extract(text, regex, group).try_cast("int")


def _epoch(year, month, day, hour, minute, second) -> Column:
    """Epoch seconds of a wall clock read as UTC, NULL for a date that does not exist."""
    stamp = F.try_make_timestamp_ntz(
        year, month, day, F.coalesce(hour, F.lit(0)), F.coalesce(minute, F.lit(0)),
        F.coalesce(second, F.lit(0)).cast("decimal(16,6)"),
    )
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), stamp)


def parse_post_time(text: Column, as_of: Column, utc_offset_seconds: int = 0) -> Column:
    """Epoch seconds of a post time, NULL when no known format fits.

    ``as_of`` (epoch seconds) stands for "now", so results are reproducible;
    ``utc_offset_seconds`` is the zone in which times without a zone are meant.
    """
    return once(F.trim(text), lambda t: _post_time(t, as_of, utc_offset_seconds))


def _post_time(t: Column, as_of: Column, utc_offset_seconds: int) -> Column:
    local_now = as_of + utc_offset_seconds
    today = local_now - F.pmod(local_now, F.lit(86400))
    year_now = F.year(F.date_add(F.lit("1970-01-01").cast("date"),
                                 F.floor(local_now / 86400).cast("int")))

    clock = F.trim(F.replace(t, F.lit(YESTERDAY), F.lit("")))
    hour, minute = _number(clock, CLOCK, 1), _number(clock, CLOCK, 2)
    yesterday = F.when(
        (hour < 24) & (minute < 60),
        today - 86400 + hour * 3600 + minute * 60 - utc_offset_seconds,
    ).otherwise(as_of - 86400)

    month_at = F.position(F.lower(F.regexp_extract(t, ZONED, 1)), F.lit(MONTHS))
    zone = (_number(t, ZONED, 7) * 3600 + _number(t, ZONED, 8) * 60) * F.when(
        F.regexp_extract(t, ZONED, 6) == "-", -1
    ).otherwise(1)
    zoned = _epoch(
        _number(t, ZONED, 9), ((month_at + 2) / 3).cast("int"), _number(t, ZONED, 2),
        _number(t, ZONED, 3), _number(t, ZONED, 4), _number(t, ZONED, 5),
    ) - zone

    full = _epoch(*[_number(t, YEAR_MONTH_DAY, g) for g in range(1, 7)]) - utc_offset_seconds
    partial = _epoch(
        year_now, *[_number(t, MONTH_DAY, g) for g in range(1, 5)], F.lit(0)
    ) - utc_offset_seconds

    return (
        F.when(t == JUST_NOW, as_of)
        .when(t.rlike(MINUTES_AGO), as_of - _number(t, MINUTES_AGO, 1) * 60)
        .when(t.rlike(HOURS_AGO), as_of - _number(t, HOURS_AGO, 1) * 3600)
        .when(t.startswith(YESTERDAY), yesterday)
        .when(t.rlike(ZONED), zoned)
        .when(t.rlike(YEAR_MONTH_DAY), full)
        .when(t.rlike(MONTH_DAY), partial)
        .cast("bigint")
    )
