import pytest
from pyspark.sql import functions as F

from hearsay.operators import metrics as M
from hearsay.schema import SCHEMAS
from hearsay.streaming import snapshots as S

SNAP = SCHEMAS["engagement_snapshots"]


def snap(post, at, views, likes=None):
    return ("bili", post, at, views, likes, 0, 0, 0)


def land(spark, folder, name, data, schema=SNAP):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/in/{name}")


def stream(spark, folder, schema=SNAP, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option(
        "recursiveFileLookup", True).parquet(f"{folder}/in")


def test_duplicates_over_batches(spark, tmp_path, rows):
    land(spark, tmp_path, "1", [snap("a", 10, 1), snap("a", 10, 1)])
    land(spark, tmp_path, "2", [snap("a", 10, 1), snap("a", 11, 2), snap("b", 10, 1)])
    out = S.run_available(S.dedupe_snapshots(stream(spark, tmp_path)), str(tmp_path))
    assert rows(spark.read.parquet(out), "post_id", "fetched_at") == [
        ("a", 10), ("a", 11), ("b", 10)]


def test_volume_counts_every_post_whenever_published(spark, tmp_path):
    schema = "platform string, published_at bigint, comment_count bigint, like_count bigint, " \
             "favorite_count bigint, view_count bigint"
    day = 86400
    land(spark, tmp_path, "1", [("bili", 100 * day, 1, 1, 1, 1)], schema)
    S.run_available(S.daily_volume(stream(spark, tmp_path, schema)), str(tmp_path), "complete")
    land(spark, tmp_path, "2", [("bili", 10 * day, 1, 1, 1, 1), ("bili", 100 * day, 2, 2, 2, 2),
                                ("bili", None, 1, 1, 1, 1)], schema)
    out = S.run_available(S.daily_volume(stream(spark, tmp_path, schema)), str(tmp_path),
                          "complete")
    got = sorted((r.n_posts, r.total_comments) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1), (2, 3)]
    with pytest.raises(ValueError):
        S.run_available(S.daily_volume(stream(spark, tmp_path, schema)), str(tmp_path), "update")


def test_growth_of_late_and_repeated_snapshots(spark, tmp_path, rows):
    files = [[snap("a", 10, 1, 1), snap("a", 30, 4, 1)], [snap("a", 20, 3, 2), snap("a", 40, 9, 5)],
             [snap("a", 10, 1, 1), snap("a", 5, 0, 0), snap("b", 1, 1, 1)]]
    for i, data in enumerate(files):
        land(spark, tmp_path, str(i), data)
        S.growth_batches(stream(spark, tmp_path), str(tmp_path)).awaitTermination()
    whole = spark.createDataFrame(sum(files, []), SNAP).distinct()
    columns = ["post_id", "fetched_at", "seconds", *[f"{c}_delta" for c in M.COUNTERS]]
    assert rows(S.growth_result(spark, str(tmp_path)), *columns) == rows(
        M.engagement_growth(whole), *columns)


@pytest.mark.parametrize("form", ["batches", "stateful"])
def test_growth_over_batches_equals_one_batch(spark, tmp_path, rows, form):
    files = [[snap("a", 10, 1, 1), snap("a", 20, 4, 1), snap("b", 15, 7)],
             [snap("a", 90000, 9, 5), snap("c", 3, 1)],
             [snap("a", 90001, 10), snap("b", 99999, 8, 2), snap("a", 90001, 10)]]
    if form == "stateful":
        for i, data in enumerate(files):
            land(spark, tmp_path, str(i), data)
            S.run_available(S.growth_stateful(stream(spark, tmp_path)), str(tmp_path))
    else:
        for i, data in enumerate(files):
            land(spark, tmp_path, str(i), data)
            S.growth_batches(stream(spark, tmp_path), str(tmp_path)).awaitTermination()
    got = (spark.read.parquet(f"{tmp_path}/out") if form == "stateful"
           else S.growth_result(spark, str(tmp_path)))
    whole = spark.createDataFrame(sum(files, []), SNAP).distinct()
    columns = ["post_id", "fetched_at", "seconds", *[f"{c}_delta" for c in M.COUNTERS]]
    assert rows(got, *columns) == rows(M.engagement_growth(whole), *columns)


def test_upsert_log_is_idempotent(spark, tmp_path, rows):
    schema = "id string, title string, seq bigint"
    land(spark, tmp_path, "1", [("a", "1", 1), ("a", "2", 2)], schema)
    S.upsert_log(stream(spark, tmp_path, schema), ["id"], "seq", str(tmp_path)).awaitTermination()
    land(spark, tmp_path, "2", [("a", "0", 0), ("b", "9", 1)], schema)
    S.upsert_log(stream(spark, tmp_path, schema), ["id"], "seq", str(tmp_path)).awaitTermination()
    base = spark.createDataFrame([("a", "old", "t"), ("z", "y", "u")],
                                 "id string, title string, tags string")
    table = S.merged(spark, base, str(tmp_path), schema, ["id"], "seq")
    want = [("a", "2", "t"), ("b", "9", None), ("z", "y", "u")]
    assert rows(table) == want
    compacted = spark.read.parquet(S.compact(table, str(tmp_path), 1))
    assert rows(S.merged(spark, compacted, str(tmp_path), schema, ["id"], "seq")) == want


def test_upsert_log_keeps_values_and_first_seen_times(spark, tmp_path, rows):
    schema = "id string, title string, fetched_at bigint, seq bigint"
    land(spark, tmp_path, "1", [("a", "new", 5, 1), ("a", None, 6, 2), ("b", "x", 7, 3)], schema)
    land(spark, tmp_path, "2", [("b", None, 8, 4)], schema)
    S.upsert_log(stream(spark, tmp_path, schema), ["id"], "seq", str(tmp_path)).awaitTermination()
    base = spark.createDataFrame([("a", "old", 1)], "id string, title string, fetched_at bigint")
    read = lambda keep: rows(S.merged(spark, base, str(tmp_path), schema, ["id"], "seq", keep))
    assert read(False) == [("a", "new", 1), ("b", "x", 7)]
    assert read(True) == [("a", None, 1), ("b", None, 7)]


def test_daily_volume_stream_equals_batch(spark, tmp_path, rows):
    from catalog.fixtures import Fixtures
    f = Fixtures(spark, "/root/testdata/sf0.001")
    posts = f.fx_posts
    posts.repartition(3).write.parquet(f"{tmp_path}/in")
    out = S.run_available(S.daily_volume(stream(spark, tmp_path, posts.schema)),
                          str(tmp_path), "complete")
    batch = M._volume(posts, [], F.lit(1).cast("bigint"))
    assert rows(spark.read.parquet(out)) == rows(batch.select(spark.read.parquet(out).columns))


VOLUME = "platform string, published_at bigint, comment_count bigint, like_count bigint, " \
         "favorite_count bigint, view_count bigint"


def test_updates_are_merged_and_a_repeated_batch_is_harmless(spark, tmp_path, rows, monkeypatch):
    day = 86400
    files = [[("bili", 5, 1, 1, 1, 1), (None, 9, 1, 1, 1, 1), ("", 9, 1, 1, 1, 1)],
             [("bili", 6, 2, 2, 2, 2), ("weibo", 3 * day, 1, None, 1, 1), (None, 8, 1, 1, 1, 1)],
             [("bili", 7, 4, 4, 4, 4), ("bili", 9 * day, 1, 1, 1, 1)]]
    run = lambda: S.run_updates(
        S.daily_volume(stream(spark, tmp_path, VOLUME)), ["day", "platform"], str(tmp_path), 8)
    land(spark, tmp_path, "0", files[0], VOLUME)
    run()
    land(spark, tmp_path, "1", files[1], VOLUME)
    merge, seen = S.buckets.merge, []

    def dies(spark, root, updates, *args, **kw):
        seen.append(updates.count())
        merge(spark, root, updates, *args, **kw)
        raise RuntimeError("after the merge, before the batch is committed")

    monkeypatch.setattr(S.buckets, "merge", dies)
    with pytest.raises(Exception, match="after the merge"):
        run()
    assert seen == [3]  # only what the batch changed was emitted
    monkeypatch.setattr(S.buckets, "merge", merge)
    run()
    land(spark, tmp_path, "2", files[2], VOLUME)
    got = S.updated(spark, run())
    whole = spark.createDataFrame(sum(files, []), VOLUME)
    assert rows(got) == rows(S.daily_volume(whole).select(got.columns))
    assert len(rows(got)) == 5


def test_updates_of_nothing(spark, tmp_path):
    land(spark, tmp_path, "0", [("bili", None, 1, 1, 1, 1)], VOLUME)
    root = S.run_updates(S.daily_volume(stream(spark, tmp_path, VOLUME)), ["day", "platform"],
                         str(tmp_path), 8)
    got = S.updated(spark, root)
    assert got.count() == 0 and "n_posts" in got.columns


DAY = 86400


def timed(spark, folder, keep=None):
    return S.growth_timed_result(spark.read.parquet(
        S.run_available(S.growth_timed(stream(spark, folder), keep), str(folder))))


def test_timed_growth_of_late_and_repeated_snapshots(spark, tmp_path, rows):
    files = [[snap("a", 10, 1, 1), snap("a", 30, 4, None)], [snap("a", 20, 3, 2)],
             [snap("a", DAY + 5, 9, 5), snap("b", 7, 1, 1)], [snap("a", 3 * DAY, 20, 9)],
             [snap("a", 10, 1, 1), snap("a", 5, 0, 0), snap("a", DAY + 1, 8, 5)],
             [snap("a", 2 * DAY + 9, 12, 6)]]
    columns = ["post_id", "fetched_at", "seconds", *[f"{c}_delta" for c in M.COUNTERS]]
    for i, data in enumerate(files):
        land(spark, tmp_path, str(i), data)
        got = timed(spark, tmp_path)
        whole = spark.createDataFrame(sum(files[: i + 1], []), SNAP).distinct()
        assert rows(got, *columns) == rows(M.engagement_growth(whole), *columns)


def test_timed_state_expires(spark, tmp_path, rows):
    days = [0, 1, 40, 41, 0, 41]
    for i, day in enumerate(days):
        land(spark, tmp_path, str(i), [snap("a", day * DAY + 10 + i, i)])
        got = rows(timed(spark, tmp_path, "10 days"), "fetched_at", "seconds")
    # The state of the first days went with its timer; the late one is dropped.
    assert sorted(got) == [(10, None), (DAY + 11, DAY + 1), (40 * DAY + 12, 39 * DAY + 1),
                           (41 * DAY + 13, DAY + 1), (41 * DAY + 15, 2)]
