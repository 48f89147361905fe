"""Reading JSON payloads and cutting page sequences."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.functions.scalars import first_non_empty

PAGE_BLOCK = 1000
# Where a record was met: struct(at, page, pos). Normalizers hand it on if the payloads have it.
ORDER = "_order"


def parsed(payloads: DataFrame) -> DataFrame:
    """Add ``v``, the body as a variant; NULL when it is not JSON. Landed payloads have it."""
    if "v" in payloads.columns:
        return payloads
    return payloads.withColumn("v", F.try_parse_json("body"))


def get(value: Column | str, path: str, kind: str = "string") -> Column:
    """Value at a path such as 'data.owner.mid', NULL when absent or of another type."""
    root = F.col(value) if isinstance(value, str) else value
    return F.try_variant_get(root, f"$.{path}" if path else "$", kind)


def text(value: Column | str, *paths: str) -> Column:
    """First non-empty text among paths, '' when none."""
    return first_non_empty(*[get(value, p) for p in paths])


def array_at(value: Column | str, path: str) -> Column:
    """Array at a path as array<variant>, empty when absent."""
    return F.coalesce(
        get(value, path, "array<variant>"), F.array().cast("array<variant>")
    )


def carried(df: DataFrame) -> list[str]:
    """The column that says where a record was met, if there is one."""
    return [ORDER] if ORDER in df.columns else []


def each(df: DataFrame, keys: Sequence[str], items: Column) -> DataFrame:
    """One row per item with its position: keys, pos, item."""
    rows = df.select(*keys, *carried(df), F.posexplode(items).alias("pos", "item"))
    if ORDER in df.columns:
        place = F.struct(f"{ORDER}.at", f"{ORDER}.page", F.col("pos").cast("bigint").alias("pos"))
        rows = rows.withColumn(ORDER, place)
    return rows


def truthy(value: Column | str, path: str) -> Column:
    """Whether a JSON value counts as set: not missing, null, false, 0 or ''."""
    return is_set(get(value, path))


def is_set(found: Column) -> Column:
    """The same of a JSON value that was read as text."""
    return ~F.coalesce(found, F.lit("")).isin("", "0", "false", "0.0")


def raw(value: Column | str) -> Column:
    return F.to_json(F.col(value) if isinstance(value, str) else value)


def epoch_or_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0).cast("bigint"))


def pages_until_empty(
    pages: DataFrame, keys: Sequence[str], empty: Column, ended: Column | None = None
) -> DataFrame:
    """Pages before the first empty one, up to and including the first that says it is the
    last. The cut is one aggregate per request, combined map-side."""
    cut = F.when(empty, F.col("page_no") - 1)
    if ended is not None:
        cut = cut.when(ended, F.col("page_no"))
    last = pages.groupBy(*keys).agg(F.min(cut).alias("_last"))
    return (
        pages.join(last, list(keys))
        .where(F.col("_last").isNull() | (F.col("page_no") <= F.col("_last")))
        .drop("_last")
    )


def first_of(items: Column, most: int | None) -> Column:
    """The first ``most`` elements of an array, all of them for None."""
    return items if most is None else F.slice(items, 1, most)
