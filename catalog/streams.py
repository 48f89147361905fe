"""Streaming queries: the given tables are landed as files, streamed, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.analytics import DAY
from catalog.fixtures import duck
from catalog.registry import query
from catalog.writes import BASE, UPDATES, both, merged_sql
from hearsay.operators import metrics as M
from hearsay.session import scratch_path
from hearsay.streaming import snapshots as S


def landed(f, df, label, per_trigger: int = 1, files: int = 4):
    """Write a table as a few files and open it as a stream."""
    path = scratch_path(f.spark, label)
    df.repartition(files).write.parquet(f"{path}/in")
    stream = f.spark.readStream.schema(df.schema).option(
        "maxFilesPerTrigger", per_trigger).parquet(f"{path}/in")
    return stream, path


def stream_dedupe(f):
    # Each snapshot lands twice.
    twice = f.fx_snapshots.unionByName(f.fx_snapshots)
    stream, path = landed(f, twice, "dedupe")
    return f.spark.read.schema(twice.schema).parquet(
        S.run_available(S.dedupe_snapshots(stream), path))


query("stream_snapshot_dedupe", duck("SELECT * FROM fx_snapshots"))(stream_dedupe)


def stream_volume(f):
    stream, path = landed(f, f.fx_posts, "volume")
    return f.spark.read.parquet(
        S.run_available(S.daily_volume(stream), path, "complete"))


VOLUME = duck(f"""
SELECT {DAY.format('published_at')} AS day, platform, count(*) AS n_posts,
  CAST(COALESCE(sum(comment_count), 0) AS BIGINT) AS total_comments,
  CAST(COALESCE(sum(like_count), 0) AS BIGINT) AS total_likes,
  CAST(COALESCE(sum(favorite_count), 0) AS BIGINT) AS total_favorites,
  CAST(COALESCE(sum(view_count), 0) AS BIGINT) AS total_views
FROM fx_posts WHERE published_at IS NOT NULL GROUP BY 1, 2""")
query("stream_daily_volume", VOLUME)(stream_volume)


def stream_volume_update(f):
    # Each of four batches emits the days it changed; they are merged into a bucketed table.
    stream, path = landed(f, f.fx_posts, "volume-update")
    return S.updated(f.spark, S.run_updates(
        S.daily_volume(stream), ["day", "platform"], path, 8))


query("stream_daily_volume_update", VOLUME)(stream_volume_update)


def stream_upsert(f, null_overwrites=True):
    updates = both(f, UPDATES, orders=f.orders)
    stream, path = landed(f, updates, "upsert")
    S.upsert_log(stream, ["id"], "seq", path).awaitTermination()
    base = both(f, BASE, customer=f.customer)
    return S.merged(f.spark, base, path, updates.schema, ["id"], "seq", null_overwrites)


query("stream_upsert", merged_sql(
    "CASE WHEN l.id IS NULL THEN b.content ELSE l.content END"))(stream_upsert)
query("stream_upsert_keep_nulls", merged_sql("COALESCE(s.content, b.content)"))(
    lambda f: stream_upsert(f, null_overwrites=False))


def stream_growth(f):
    stream, path = landed(f, f.fx_snapshots, "growth")
    S.growth_batches(stream, path).awaitTermination()
    return S.growth_result(f.spark, path)


def stream_growth_late(f):
    # Newest first, and every snapshot lands twice.
    twice = f.fx_snapshots.unionByName(f.fx_snapshots)
    path = scratch_path(f.spark, "growth-late")
    twice.repartitionByRange(4, F.desc("fetched_at")).write.parquet(f"{path}/in")
    stream = f.spark.readStream.schema(twice.schema).option(
        "maxFilesPerTrigger", 1).parquet(f"{path}/in")
    S.growth_batches(stream, path).awaitTermination()
    return S.growth_result(f.spark, path)


def stream_growth_stateful(f):
    stream, path = landed(f, f.fx_snapshots, "growth-state", per_trigger=4)
    return f.spark.read.parquet(S.run_available(S.growth_stateful(stream), path))


def stream_growth_timed(f):
    # Newest first in four batches, and every snapshot lands twice.
    twice = f.fx_snapshots.unionByName(f.fx_snapshots)
    path = scratch_path(f.spark, "growth-timed")
    twice.repartitionByRange(4, F.desc("fetched_at")).write.parquet(f"{path}/in")
    stream = f.spark.readStream.schema(twice.schema).option(
        "maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return S.growth_timed_result(f.spark.read.parquet(
        S.run_available(S.growth_timed(stream), path)))


GROWTH = duck(f"""
SELECT platform, post_id, fetched_at, fetched_at - lag(fetched_at) OVER w AS seconds,
  {', '.join(f'{c} - lag({c}) OVER w AS {c}_delta' for c in M.COUNTERS)}
FROM fx_snapshots WINDOW w AS (PARTITION BY platform, post_id ORDER BY fetched_at)""")
query("stream_growth", GROWTH)(stream_growth)
query("stream_growth_late", GROWTH)(stream_growth_late)
query("stream_growth_stateful", GROWTH)(stream_growth_stateful)
query("stream_growth_timed", GROWTH)(stream_growth_timed)
