"""Engagement snapshots and discussion volume as streams."""

from __future__ import annotations

import json
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from hearsay.functions.scalars import utc_day
from hearsay.operators.merge import first_wins, latest_wins, upsert
from hearsay.operators.metrics import COUNTERS
from hearsay.operators.shared import previous_in_blocks, semi_join
from hearsay.sources import buckets

SNAPSHOT_KEY = ("platform", "post_id", "fetched_at")


def dedupe_snapshots(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """Snapshots with repeats of a (platform, post, second) dropped.

    By default every key is remembered, so nothing is lost however late it comes. A ``delay``
    bounds the state instead: repeats are only known while they are within it, and rows that
    are later than it are dropped.
    """
    if delay is None:
        return stream.dropDuplicates(list(SNAPSHOT_KEY))
    timed = stream.withColumn("event_time", F.timestamp_seconds("fetched_at"))
    return (
        timed.withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(list(SNAPSHOT_KEY)).drop("event_time")
    )


def daily_volume(stream: DataFrame) -> DataFrame:
    """Posts and their counters per publish day (UTC) and platform, of all posts whenever they
    were published. The state is one row per day and platform, so it needs no watermark; write
    in complete mode."""
    total = {n: F.coalesce(F.sum(c), F.lit(0)).cast("bigint") for n, c in (
        ("total_comments", "comment_count"), ("total_likes", "like_count"),
        ("total_favorites", "favorite_count"), ("total_views", "view_count"))}
    return (
        stream.where(F.col("published_at").isNotNull())
        .groupBy(utc_day(F.col("published_at")).alias("day"), "platform")
        .agg(F.count(F.lit(1)).alias("n_posts"), *[v.alias(k) for k, v in total.items()])
    )


def run_available(stream: DataFrame, path: str, mode: str = "append") -> str:
    """Process what is there and stop; returns the folder of the results.

    Append streams go to the exactly-once file sink. In complete mode each batch replaces
    the result folder, which only ever holds one whole result. Update mode is refused: a batch
    would replace rows that it does not hold; :func:`run_updates` merges them by key.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"mode {mode!r}: only append and complete results are whole")
    out = f"{path}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(
        availableNow=True
    ).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(
            lambda df, _: df.write.mode("overwrite").parquet(out)
        ).start()
    query.awaitTermination()
    return out


_KEY = "_key"


def run_updates(stream: DataFrame, keys: Sequence[str], path: str, n_buckets: int = 64) -> str:
    """Process what is there in update mode and stop; returns the bucketed table of the results.

    A batch emits the rows that it changed, whole. They are written to the batch's own folder, so
    the stateful plan runs once a batch, and are then merged by ``keys`` into the buckets they touch
    (:mod:`hearsay.sources.buckets`); rows of other buckets are neither read nor written. A batch
    that is repeated after a crash replaces its folder and merges the same rows again, which
    changes nothing. NULL keys are keys like others. Read the result with :func:`updated`.
    """
    root = f"{path}/table"

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        emitted = f"{path}/emitted/{BATCH}={batch_id}"
        # JSON of the key: a text that is never NULL and differs where any part does.
        keyed = batch.withColumn(_KEY, F.to_json(F.struct(*keys)))
        keyed.write.mode("overwrite").parquet(emitted)
        rows = spark.read.schema(keyed.schema).parquet(emitted)
        if buckets.version(spark, root) is None:
            buckets.create(rows, root, [_KEY], n_buckets)
        else:
            buckets.merge(spark, root, rows.withColumn(BATCH, F.lit(batch_id)), BATCH, kept=())
            buckets.expire(spark, root)

    stream.writeStream.outputMode("update").option(
        "checkpointLocation", f"{path}/checkpoint"
    ).trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
    return root


def updated(spark: SparkSession, root: str) -> DataFrame:
    """The rows that :func:`run_updates` holds, one per key."""
    return buckets.read(spark, root).drop(_KEY)


# ---- upsert log -------------------------------------------------------------------------

BATCH = "batch_id"


def upsert_log(stream: DataFrame, keys: Sequence[str], seq: str, path: str) -> StreamingQuery:
    """Collect updates of a table from a stream, ready for :func:`merged`.

    A batch writes its rows to a folder of its own, so a repeated batch changes nothing and no
    batch rewrites the table. Rows are kept as they came (equal ones once): an earlier value that
    a later NULL must not hide, and the first-seen time, are only known when all are merged.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(
            f"{path}/log/{BATCH}={batch_id}"
        )

    return (
        stream.writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).foreachBatch(append).start()
    )


def merged(spark: SparkSession, base: DataFrame, path: str, schema, keys: Sequence[str],
           seq: str, null_overwrites: bool = True) -> DataFrame:
    """The table with all logged updates applied: one aggregate per key over base and log."""
    log = spark.read.schema(schema).parquet(f"{path}/log")
    return upsert(base, log, keys, seq, null_overwrites)


def compact(merged_table: DataFrame, path: str, version: int) -> str:
    """Write the merged table as the next base; the log before it can then be removed."""
    out = f"{path}/base/version={version}"
    merged_table.write.mode("overwrite").parquet(out)
    return out


# ---- growth -----------------------------------------------------------------------------

BUCKETS = 16


def growth_batches(stream: DataFrame, path: str, block_seconds: int = 86400) -> StreamingQuery:
    """Change of every counter since the post's previous snapshot, batch by batch.

    Every batch appends its new snapshots to the state, in hash buckets of the post, and emits
    the changes of the new rows and, again, of stored rows that a late one now precedes;
    :func:`growth_result` takes the last of each. A batch reads the touched buckets' rows of the touched
    posts and differences them in time blocks, so neither a busy post nor its history passes
    through one task. Repeated snapshots change nothing; a repeated batch replaces its folders.
    """
    key = ["platform", "post_id"]
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int").alias("bucket")

    def difference(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = batch.select(*SNAPSHOT_KEY, *COUNTERS, bucket).schema
        rows = first_wins(batch.select(*SNAPSHOT_KEY, *COUNTERS), list(SNAPSHOT_KEY),
                          list(COUNTERS)).select("*", bucket)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
        stored = spark.createDataFrame([], schema)
        if batch_id > 0:
            stored = (
                spark.read.schema(schema.add(BATCH, "long")).option("basePath", f"{path}/state")
                .parquet(f"{path}/state").where(F.col("bucket").isin(touched))
                .where(F.col(BATCH) < batch_id).select(rows.columns)
            )
        fresh = rows.join(stored, ["bucket", *SNAPSHOT_KEY], "left_anti").select(rows.columns)
        history = semi_join(stored, fresh.select(*key).distinct(), key, ["fetched_at"])
        both = fresh.withColumn("is_new", F.lit(True)).unionByName(
            history.withColumn("is_new", F.lit(False)))
        changes = previous_in_blocks(both, key, "fetched_at", [*COUNTERS, "is_new"],
                                     block_seconds)
        changes.where(F.col("is_new") | F.coalesce("prev.is_new", F.lit(False))).select(
            *SNAPSHOT_KEY, (F.col("fetched_at") - F.col("prev.fetched_at")).alias("seconds"),
            *[(F.col(c) - F.col(f"prev.{c}")).alias(f"{c}_delta") for c in COUNTERS],
        ).write.mode("overwrite").parquet(f"{path}/out/{BATCH}={batch_id}")
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{path}/state/{BATCH}={batch_id}")
        rows.unpersist()

    return (
        stream.writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).foreachBatch(difference).start()
    )


def growth_result(spark: SparkSession, path: str) -> DataFrame:
    """The last change that :func:`growth_batches` has given for every snapshot."""
    return latest_wins(spark.read.parquet(f"{path}/out"), list(SNAPSHOT_KEY), BATCH).drop(BATCH)


def growth_stateful(stream: DataFrame) -> DataFrame:
    """The same changes with the last snapshot of each post in Spark's state store.

    Only posts of the current batch are touched, which suits very many posts of which few
    change. One task orders the rows a post has in a batch (at most one per second), so bound
    the batch (``maxFilesPerTrigger``) or take :func:`growth_batches` where single posts are
    extremely busy. A snapshot that comes after a newer one of its post has no difference here:
    it is emitted with NULLs (:func:`growth_batches` corrects them).
    """
    import pandas as pd

    names = list(COUNTERS)
    output = "platform string, post_id string, fetched_at bigint, seconds bigint, " + ", ".join(
        f"{c}_delta bigint" for c in names)
    state_type = ", ".join(f"{c} bigint" for c in ["fetched_at", *names])
    columns = ["fetched_at", *names]

    def update(key, frames, state):
        rows = pd.concat(list(frames))[columns].astype("Int64")
        rows = rows.drop_duplicates("fetched_at").sort_values("fetched_at")
        if state.exists:
            last = pd.DataFrame([state.get], columns=columns).astype("Int64")
            late = rows[rows["fetched_at"] < last["fetched_at"].iloc[0]]
            if len(late):
                yield pd.DataFrame({"platform": key[0], "post_id": key[1],
                                    "fetched_at": late["fetched_at"].to_numpy(),
                                    "seconds": pd.array([None] * len(late), "Int64")}
                                   | {f"{c}_delta": pd.array([None] * len(late), "Int64")
                                      for c in names})
            rows = rows[rows["fetched_at"] > last["fetched_at"].iloc[0]]
            before = pd.concat([last, rows])
        else:
            before = rows
        if rows.empty:
            return
        changed = before.diff().tail(len(rows))
        final = rows.iloc[-1]
        state.update(tuple(None if pd.isna(final[c]) else int(final[c]) for c in columns))
        out = pd.DataFrame({"platform": key[0], "post_id": key[1],
                            "fetched_at": rows["fetched_at"].to_numpy()})
        out["seconds"] = changed["fetched_at"].array
        for c in names:
            out[f"{c}_delta"] = changed[c].array
        yield out

    return stream.groupBy("platform", "post_id").applyInPandasWithState(
        update, output, state_type, "append", "NoTimeout"
    )


# ---- growth in timed state ----------------------------------------------------------------

DAY_SECONDS = 86400
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def growth_timed(stream: DataFrame, keep: str | None = None) -> DataFrame:
    """Change of every counter since the post's previous snapshot, from keyed state.

    The state of a (platform, post, day) maps its seconds to their counters. New snapshots are
    emitted with their difference, and so is, again, a stored one that a late snapshot now
    precedes; repeated ones change nothing. The first snapshot of a day is marked: its difference
    reaches back to another key, and :func:`growth_timed_result` takes it from what that day
    emitted last. So a busy post is as many keys as it has days, and no key has more than 86,400
    entries.

    With ``keep`` (such as "30 days") the state of a day is dropped by a timer when the event-time
    watermark, that far behind the newest snapshot, passes the day's end; snapshots that come
    later than that are dropped. Without it every snapshot is remembered. The state needs the
    RocksDB store, which the session is told to use.
    """
    stream.sparkSession.conf.set(_STORE, _ROCKSDB)
    timed = stream.select(
        *SNAPSHOT_KEY, *COUNTERS, F.floor(F.col("fetched_at") / DAY_SECONDS).alias("day"),
        *([F.timestamp_seconds("fetched_at").alias("event_time")] if keep else []))
    if keep:
        timed = timed.withWatermark("event_time", keep)
    output = ", ".join([
        "platform string", "post_id string", "fetched_at bigint", "day bigint", "opens boolean",
        "seconds bigint", *(f"{c} bigint" for c in COUNTERS),
        *(f"{c}_delta bigint" for c in COUNTERS), "version bigint"])
    return timed.groupBy("platform", "post_id", "day").transformWithState(
        statefulProcessor=DayOfSnapshots(bool(keep)), outputStructType=output,
        outputMode="Append", timeMode="EventTime" if keep else "None")


_Emitted = Row(*SNAPSHOT_KEY, "day", "opens", "seconds", *COUNTERS,
               *(f"{c}_delta" for c in COUNTERS), "version")


class DayOfSnapshots(StatefulProcessor):
    """State and differences of one post on one day.

    Most keys hold a few snapshots, so what a key costs counts: rows instead of frames, and one
    state value (seconds with counters, packed), so that a key is one read and one write.
    """

    def __init__(self, expires: bool):
        self.expires = expires

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "version bigint, seen string")

    def handleInputRows(self, key, rows, timerValues):
        stored = self.state.get()
        version, packed = (stored[0], json.loads(stored[1])) if stored else (0, [])
        known = {at: values for at, *values in packed}
        fresh = {}
        for row in rows:
            at = row["fetched_at"]
            if at not in known and at not in fresh:
                fresh[at] = [row[c] for c in COUNTERS]
        if not fresh:
            return
        version += 1
        known |= fresh
        order = sorted(known)
        self.state.update((version, json.dumps([[at, *known[at]] for at in order])))
        if self.expires:
            self.handle.registerTimer((key[2] + 1) * DAY_SECONDS * 1000)
        for before, at in zip([None, *order], order):
            if at not in fresh and before not in fresh:
                continue
            now, old = known[at], known.get(before, [None] * len(COUNTERS))
            delta = [None if a is None or b is None else a - b for a, b in zip(now, old)]
            yield _Emitted(key[0], key[1], at, key[2], before is None,
                           None if before is None else at - before, *now, *delta, version)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def growth_timed_result(emitted: DataFrame) -> DataFrame:
    """The last difference that :func:`growth_timed` gave for every snapshot, with those of the
    first of each day taken from the last of the day before it that has any."""
    last = latest_wins(emitted, list(SNAPSHOT_KEY), "version")
    key = ["platform", "post_id"]
    ends = last.groupBy(*key, "day").agg(
        F.max_by(F.struct("fetched_at", *COUNTERS), "fetched_at").alias("end"))
    before = ends.select(*key, "day", F.lag("end").over(
        Window.partitionBy(*key).orderBy("day")).alias("prev"), F.lit(True).alias("opens"))
    return last.join(before, [*key, "day", "opens"], "left").select(
        *SNAPSHOT_KEY,
        F.when(F.col("opens"), F.col("fetched_at") - F.col("prev.fetched_at"))
        .otherwise(F.col("seconds")).alias("seconds"),
        *[F.when(F.col("opens"), F.col(c) - F.col(f"prev.{c}")).otherwise(F.col(f"{c}_delta"))
          .alias(f"{c}_delta") for c in COUNTERS])
