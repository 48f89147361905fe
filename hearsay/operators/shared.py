"""Plan shapes that hold when one key owns a large share of the rows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 16
# Up to this rank Spark prunes each input partition to k rows per key before the shuffle.
_PRUNED_RANK = 1000


def every_salt(salts: int = SALTS) -> Column:
    """Generator of all salts, for the side of a join that is repeated."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))


def top_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of every key in a total order, with their rank 1..k.

    For small ``k`` the rank filter is applied map-side, so the task of a hot key sees at most
    k rows per input partition. For a large ``k`` the same is done by hand: rank within random
    slices of the key first, then among the survivors. Both are exact.
    """
    if k > _PRUNED_RANK:
        slices = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(8 * SALTS)))
            .withColumn("_r", F.row_number().over(slices))
            .where(F.col("_r") <= k)
            .drop("_r", "_slice")
        )
    within = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(within)).where(F.col(rank) <= k)


def semi_join(
    rows: DataFrame, keys: DataFrame, on: Sequence[str], spread_by: Sequence[str],
    salts: int = SALTS,
) -> DataFrame:
    """Rows whose key is in ``keys`` (one row per key).

    Each key is repeated once per salt and the rows are spread over the salts, so the rows of
    one hot key land in ``salts`` partitions. When ``keys`` is measured small, Spark
    broadcasts it and nothing of ``rows`` moves.
    """
    salted_keys = keys.select(*on).withColumn("_salt", every_salt(salts))
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    return salted_rows.join(salted_keys, [*on, "_salt"], "left_semi").drop("_salt")


def repeat_rows(df: DataFrame, times: str, chunk: int = 10_000) -> DataFrame:
    """Every row ``times`` times, without ever building an array of more than ``chunk``."""
    n = F.col(times)
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / chunk)))
    size = F.least(n - F.col("_block") * chunk, F.lit(chunk).cast("bigint"))
    return (
        df.where(n > 0)
        .withColumn("_block", blocks)
        .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
        .drop("_block", "_i", times)
    )


def _in_blocks(df: DataFrame, keys: Sequence[str], order: str, block: int) -> DataFrame:
    # Partitioned once; the windows and the per-block aggregate need no further shuffle.
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    return blocked.repartition(*keys, "_block")


def previous_in_blocks(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], block: int
) -> DataFrame:
    """Add ``prev``: the struct(order, *values) of the preceding row of the same key.

    ``lag`` over a hot key would run in one task. Here the integer ``order`` column is cut in
    blocks: lag within (key, block), and the last row of the previous block for the first.
    Needs (keys, order) to be unique; a block then holds at most ``block`` rows.
    """
    payload = F.struct(order, *values)
    blocked = _in_blocks(df, keys, order, block)
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    rows = blocked.withColumn("_prev", F.lag(payload).over(inside))
    lasts = blocked.groupBy(*keys, "_block").agg(F.max_by(payload, order).alias("_last"))
    carried = lasts.select(
        *keys, "_block",
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carried"),
    )
    return (
        rows.join(carried, [*keys, "_block"], "left")
        .withColumn("prev", F.coalesce("_prev", "_carried"))
        .drop("_prev", "_carried", "_block")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: str, block: int, name: str
) -> DataFrame:
    """Add the inclusive running sum of ``value`` along the integer ``order`` of each key,
    in blocks for the same reason as :func:`previous_in_blocks`."""
    blocked = _in_blocks(df, keys, order, block)
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    offsets = sums.select(
        *keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    return (
        blocked.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_block")
    )
