"""Views, retrieval and metrics on small tables with the awkward cases in them."""

import re

import pytest
from pyspark.sql import functions as F

from hearsay.operators import metrics as M, retrieve as R, views as V
from hearsay.operators.retrieve import Corpus
from hearsay.operators.shared import previous_in_blocks, repeat_rows, running_total, top_k_per_key
from hearsay.schema import SCHEMAS, TABLE_KEYS, to_zh
from hearsay.sources.tables import create_tables, read_tables, row_counts, scan, write_table


def table(spark, name, *rows):
    fields = SCHEMAS[name].fieldNames()
    return spark.createDataFrame([tuple(r.get(c) for c in fields) for r in rows], SCHEMAS[name])


@pytest.fixture(scope="module")
def tables(spark):
    t = {n: table(spark, n) for n in SCHEMAS}
    t["bili_videos"] = table(
        spark, "bili_videos",
        dict(bvid="7", aid=70, title="seven", desc="d", owner_mid=1, owner_name="o",
             pubdate=86400, reply=3, like=5, favorite=1, share=2, view=100),
        dict(bvid="BV2", aid=20, title="two", pubdate=None, like=0))
    t["zhihu_questions"] = table(
        spark, "zhihu_questions",
        dict(id=7, title="q", detail="qd", created=90000, answer_count=2, follower_count=4))
    t["zhihu_answers"] = table(
        spark, "zhihu_answers",
        dict(id=8, question_id=7, author_name="a", voteup_count=9, created_time=90001,
             content="好"), dict(id=9, question_id=1, voteup_count=1, content="x"))
    t["weibo_posts"] = table(spark, "weibo_posts", dict(id="7", text="w", created_ts=86500))
    t["tieba_threads"] = table(spark, "tieba_threads", dict(tid="5", title="t", reply_num=1))
    t["bili_comments"] = table(
        spark, "bili_comments", dict(rpid=1, oid=70, message="m1", likes=1),
        dict(rpid=2, oid=70, message="m2", likes=4), dict(rpid=3, oid=20, message="m3"))
    t["zhihu_answer_comments"] = table(
        spark, "zhihu_answer_comments", dict(comment_id=4, answer_id=8, content="c"))
    t["weibo_comments"] = table(spark, "weibo_comments", dict(comment_id="w1", post_id="7"))
    t["tieba_comments"] = table(spark, "tieba_comments", dict(pid="p1", tid="5", floor=2))
    t["keyword_posts"] = table(
        spark, "keyword_posts",
        dict(keyword="k", platform="bili", post_id="7", run_id=1, rank=1, fetched_at=10),
        dict(keyword="k", platform="bili", post_id="7", run_id=2, rank=1, fetched_at=20),
        dict(keyword="k", platform="bili", post_id="BV2", run_id=1, rank=2, fetched_at=11),
        dict(keyword="k", platform="zhihu", post_id="7", run_id=3, rank=1, fetched_at=30),
        dict(keyword="k", platform="tieba", post_id="gone", run_id=4, rank=1, fetched_at=40),
        dict(keyword="z", platform="weibo", post_id="7", run_id=5, rank=1, fetched_at=5))
    t["scrape_runs"] = table(
        spark, "scrape_runs",
        dict(run_id=1, keyword="k", platform="bili", started_at=10, finished_at=15),
        dict(run_id=2, keyword="k", platform="bili", started_at=20, error="SoftBanned: x"))
    return t


@pytest.fixture(scope="module")
def corpus(tables):
    return Corpus.from_tables(tables)


def test_views(tables, rows):
    posts = V.posts_unified(tables)
    assert posts.columns == list(V.POST_COLUMNS)
    urls = rows(posts, "platform", "post_id", "url")
    assert ("zhihu_answer", "8", "https://www.zhihu.com/question/7/answer/8") in urls
    assert ("bili", "7", "https://www.bilibili.com/video/7") in urls
    assert len(urls) == 7
    assert rows(V.comments_unified(tables).where("platform = 'tieba'"),
                "post_id", "comment_id", "like_count") == [("5", "p1", None)]
    linked = V.keyword_posts_unified(tables["keyword_posts"], tables["scrape_runs"])
    assert rows(linked.where("run_id in (1, 4)"), "post_id", "run_started_at") == [
        ("7", 10), ("BV2", 10), ("gone", None)]
    assert to_zh(posts).columns[:3] == ["平台", "帖子ID", "笔记链接"]


def test_sql_views(spark, tables):
    V.create_views(tables)
    assert spark.sql("SELECT count(*) FROM comments_unified").first()[0] == 6
    assert spark.sql("SELECT count(*) FROM posts_unified").first()[0] == 7
    assert spark.sql("SELECT count(*) FROM keyword_posts_unified").first()[0] == 6


def test_equal_ids_do_not_meet_across_platforms(corpus, rows):
    got = rows(R.posts_for_keyword(corpus, "k"), "platform", "post_id")
    assert got == [("bili", "7"), ("bili", "7"), ("bili", "BV2"), ("zhihu_question", "7")]
    assert rows(R.posts_for_keyword(corpus, "k", distinct_posts=True), "platform", "post_id") == [
        ("bili", "7"), ("bili", "BV2"), ("zhihu_question", "7")]
    assert rows(R.posts_for_keyword(corpus, "z"), "platform") == [("weibo",)]
    assert rows(R.posts_for_keyword(corpus, "k", ["zhihu"]), "post_id") == [("7",)]


def test_order_is_newest_first_nulls_last(corpus):
    ids = [r.post_id for r in R.posts_for_keyword(corpus, "k", distinct_posts=True).collect()]
    assert ids == ["7", "7", "BV2"]


def test_comments_and_answers(corpus, rows):
    assert rows(R.answers_for_keyword(corpus, "k"), "post_id") == [("8",)]
    assert rows(R.comments_for_keyword(corpus, "k"), "comment_id") == [
        ("1",), ("2",), ("3",), ("4",)]
    assert rows(R.comments_for_keyword(corpus, "z"), "comment_id") == [("w1",)]
    assert [r.comment_id for r in R.comments_for_post(corpus, "70").collect()] == ["2", "1"]
    assert rows(R.posts_for_run(corpus, 3), "platform", "post_id") == [
        ("zhihu_answer", "8"), ("zhihu_question", "7")]
    assert rows(R.comments_for_run(corpus, 3), "comment_id") == [("4",)]


def test_stub_links_survive(corpus):
    last = R.last_linked_posts(corpus, 3).collect()
    assert [(r.post_id, r.title) for r in last] == [("gone", None), ("7", "q"), ("7", "seven")]
    assert [r.post_id for r in R.last_linked_posts(corpus, 3, "weibo").collect()] == ["7"]


def test_record_lookup(tables):
    assert R.record_lookup(tables, "question", "7").first().title == "q"
    assert R.record_lookup(tables, "video", "none").isEmpty()


def test_volume_counts_links_and_drops_unknown_days(corpus, rows):
    assert rows(M.volume_by_day(corpus, "k"), "day", "platform", "n_posts", "total_comments",
                "total_likes", "total_views") == [
        ("1970-01-02", "bili", 2, 6, 10, 200), ("1970-01-02", "zhihu_question", 1, 2, 0, 0)]
    assert rows(M.volume_by_day(corpus, "k", distinct_posts=True), "platform", "n_posts") == [
        ("bili", 1), ("zhihu_question", 1)]
    none = M.volume_by_day(corpus, "nothing")
    assert none.columns == M.volume_by_day(corpus, "k").columns and none.isEmpty()
    everything = M.volume_by_day_all_keywords(corpus).where("keyword = 'k'").drop("keyword")
    assert rows(everything) == rows(M.volume_by_day(corpus, "k"))


def test_overview(corpus):
    r = M.overview_kpis(corpus, "k").first()
    assert (r.n_posts, r.n_bili, r.n_zhihu_question, r.n_weibo) == (4, 3, 1, 0)
    assert (r.first_day, r.last_day) == ("1970-01-02", "1970-01-02")
    empty = M.overview_kpis(corpus, "nothing").first()
    assert empty.n_posts == 0 and empty.first_day is None


def test_top_posts_repeat_per_link_and_fall_back_to_content(corpus):
    top = M.top_posts(corpus, "k", "like_count", 2).collect()
    assert [(r.post_id, r.label) for r in top] == [("7", "seven"), ("7", "seven")]
    assert M.top_posts(corpus, "z", "comment_count").isEmpty()


def test_samples(spark, corpus):
    r = M.sample_posts_with_top_comment(corpus, "k").collect()
    assert [(x.post_id, x.likes, x.top_comment) for x in r] == [
        ("7", 5, "m2"), ("7", 5, "m2"), ("BV2", 0, "m3")]
    # No likes anywhere: comments decide.
    no_likes = Corpus(corpus.posts.withColumn("like_count", F.lit(None).cast("bigint")),
                      corpus.comments, corpus.links, corpus.videos, corpus.answers)
    ids = [(x.platform, x.post_id) for x in
           M.sample_posts_with_top_comment(no_likes, "k").collect()]
    assert ids == [("bili", "7"), ("bili", "7"), ("zhihu_question", "7")]


def test_histogram_keeps_every_positive_value(spark, corpus):
    h = M.engagement_histogram(corpus, "k").collect()
    assert sum(r.n for r in h) == 3  # the video twice, the answer once
    assert min(r.bin for r in h) == 0 and max(r.bin for r in h) <= 28


def test_runs(tables):
    s = R.run_summary(tables["scrape_runs"], "k").collect()
    assert [(r.run_id, r.started, r.finished) for r in s] == [
        (2, "1970-01-01 00:00:20", None), (1, "1970-01-01 00:00:10", "1970-01-01 00:00:15")]
    assert [(r.duration, r.ok) for r in R.recent_runs(tables["scrape_runs"]).collect()] == [
        (0, False), (5, True)]


def test_growth_across_blocks(spark, rows):
    snaps = spark.createDataFrame(
        [("bili", "1", t, v, None, v, 0, 0) for t, v in
         [(10, 1), (20, 4), (86500, 10), (86400 * 5, 12)]], SCHEMAS["engagement_snapshots"])
    got = rows(M.engagement_growth(snaps), "fetched_at", "seconds", "view_count_delta",
               "like_count_delta")
    assert sorted(got) == [(10, None, None, None), (20, 10, 3, None),
                           (86500, 86480, 6, None), (432000, 345500, 2, None)]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_block_helpers_equal_plain_windows(spark, rows, block):
    df = spark.range(200).select(
        (F.col("id") % 7).alias("k"), F.col("id").alias("at"), (F.col("id") * 3 % 11).alias("v"))
    df.createOrReplaceTempView("block_input")
    plain = spark.sql("""SELECT k, at, lag(v) OVER (PARTITION BY k ORDER BY at) AS p,
        sum(v) OVER (PARTITION BY k ORDER BY at) AS s FROM block_input""")
    mine = running_total(previous_in_blocks(df, ["k"], "at", ["v"], block), ["k"], "at", "v",
                         block, "s")
    assert rows(mine, "k", "at", "prev.v", "s") == rows(plain)


def test_top_k_is_exact_beyond_the_pruned_rank(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5).alias("k"), "id")
    big = top_k_per_key(df, ["k"], [F.desc("id")], 2500)
    for k, n in [(1, 2500), (2, 2500)]:
        part = big.where(F.col("k") == k)
        want = [r.id for r in df.where(F.col("k") == k).orderBy(F.desc("id")).limit(n).collect()]
        assert [r.id for r in part.orderBy("rank").collect()] == want


def test_repeat_rows_in_chunks(spark):
    df = spark.createDataFrame([("a", 25), ("b", 10), ("c", 1), ("d", 0)], "x string, n bigint")
    assert {r.x: r["count"] for r in repeat_rows(df, "n", 10).groupBy("x").count().collect()} == {
        "a": 25, "b": 10, "c": 1}


def test_tables_on_disk(spark, tables, tmp_path, rows):
    root = str(tmp_path / "db")
    write_table(tables["bili_videos"].drop("tags"), root, "bili_videos")
    create_tables(spark, root)
    create_tables(spark, root)
    back = read_tables(spark, root)
    assert set(back) == set(TABLE_KEYS)
    assert back["bili_videos"].schema == SCHEMAS["bili_videos"]
    assert rows(row_counts(back)) == [("bili_videos", 2)]
    found = scan(back["bili_videos"], "like > 0", parse_raw=True)
    assert rows(found, "bvid", "raw_parsed") == [("7", None)]


def test_measured_keys_are_broadcast_and_give_the_same(spark, tables, rows):
    plain, measured = Corpus.from_tables(tables), Corpus.from_tables(tables, measure_keys=True)
    for fn in (R.posts_for_keyword, R.answers_for_keyword, R.comments_for_keyword):
        assert rows(fn(measured, "k")) == rows(fn(plain, "k"))
    text = R.comments_for_keyword(measured, "k")._jdf.queryExecution().executedPlan().toString()
    # The outermost join is the one with the comments; below the cached keys are other plans.
    assert re.search(r"(\w+Join) ", text).group(1) == "BroadcastHashJoin"
    assert measured.measured
    measured.release()
    assert not measured.measured
