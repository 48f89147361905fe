"""Idempotent writes: upsert, insert-or-ignore, snapshots, run ledger."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

def latest_wins(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per key: the one with the highest ``seq``. Combined map-side, so a key with
    very many updates does not collect in one task."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("_row")).select(
        *keys, "_row.*"
    )


def first_wins(rows: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """One row per key: the one with the lowest ``seq``."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(
        F.min_by(F.struct(*values), F.struct(*seq)).alias("_row")
    ).select(*keys, "_row.*")


def upsert(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], seq: str,
    null_overwrites: bool = True, kept: Sequence[str] = ("fetched_at",),
) -> DataFrame:
    """``base`` with ``updates`` merged in by key.

    Only columns that ``updates`` has are overwritten; columns it lacks keep their value.
    A supplied NULL overwrites unless ``null_overwrites`` is False. ``kept`` columns hold
    their first value (first-seen time). ``seq`` orders the updates of a key; the result
    keeps the schema of ``base``, which has one row per key and no NULL in a key.

    Only the updates are aggregated, with map-side combine, and joined to the base. Where the base
    is bucketed on the key (``write_table``), it is neither shuffled nor rebuilt: only the reduced
    updates move. Keys are unique on both sides of the join, so no key is hot there.
    """
    order = F.col(seq)
    reduced, merged = [F.lit(True).alias("_there")], []
    for n, c in enumerate(base.columns):
        if c in keys:
            merged.append(F.col(c))
        elif c not in updates.columns:
            merged.append(F.col(f"_b.{c}").alias(c))
        else:
            old, new, given = F.col(f"_b.{c}"), F.col(f"_u{n}"), F.col(c).isNotNull()
            if c in kept:
                reduced.append(F.min_by(c, F.when(given, order)).alias(f"_u{n}"))
                value = F.coalesce(old, new)
            elif null_overwrites:
                reduced.append(F.max_by(c, order).alias(f"_u{n}"))
                value = F.when(F.col("_there"), new).otherwise(old)
            else:
                reduced.append(F.max_by(c, F.when(given, order)).alias(f"_u{n}"))
                value = F.coalesce(new, old)
            merged.append(value.cast(base.schema[c].dataType).alias(c))
    changes = updates.groupBy(*keys).agg(*reduced)
    values = [c for c in base.columns if c not in keys]
    stored = base.select(*keys, F.struct(*values).alias("_b")) if values else base
    return stored.join(changes, list(keys), "full_outer").select(*merged)


def insert_ignore(
    base: DataFrame, new: DataFrame, keys: Sequence[str], seq: Sequence[str]
) -> DataFrame:
    """``base`` plus the rows of ``new`` whose key is not there yet, first one wins."""
    fresh = first_wins(new, keys, seq).join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def append_snapshots(base: DataFrame, new: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Append engagement snapshots; a second one in the same second is ignored."""
    return insert_ignore(base, new, ["platform", "post_id", "fetched_at"], seq)


def open_runs(requests: DataFrame) -> DataFrame:
    """Run rows for requests (keyword, platform, requested_count, started_at, config).

    The id is a hash of what identifies a run, so opening twice gives the same row.
    """
    return requests.select(
        F.xxhash64("keyword", "platform", "started_at").alias("run_id"),
        "keyword", "platform", "requested_count", "started_at",
        F.lit(None).cast("bigint").alias("finished_at"),
        F.lit(None).cast("bigint").alias("posts_fetched"),
        F.lit(None).cast("bigint").alias("comments_fetched"),
        "config", F.lit(None).cast("string").alias("error"),
    )


def close_runs(runs: DataFrame, results: DataFrame, seq: str = "finished_at") -> DataFrame:
    """Run rows completed by results (run_id, finished_at, posts_fetched, comments_fetched,
    error)."""
    return upsert(runs, results, ["run_id"], seq, kept=())


def seen_post_ids(links: DataFrame, keyword: str | None = None,
                  platform: str | None = None) -> DataFrame:
    """Distinct posts already linked, for one keyword and platform or for all."""
    if keyword is not None:
        links = links.where(F.col("keyword") == keyword)
    if platform is not None:
        links = links.where(F.col("platform") == platform)
    return links.where(F.col("post_id").isNotNull()).select(
        "keyword", "platform", "post_id"
    ).distinct()


def evolve(df: DataFrame, schema) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones NULL, types cast."""
    have = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in have else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def lists_to_json(df: DataFrame) -> DataFrame:
    """Arrays, maps, structs and variants as JSON text, for text-typed storage."""
    nested = ("array", "map", "struct", "variant")
    return df.select([
        F.to_json(F.col(name)).alias(name) if kind.startswith(nested) else F.col(name)
        for name, kind in df.dtypes
    ])
