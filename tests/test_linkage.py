import json
import re

import pytest

from hearsay.plans import linkage as L
from hearsay.plans.ingest import merge_batch, normalize_batch
from hearsay.schema import SCHEMAS
from hearsay.sources import buckets

AS_OF = 1718000000
SCHEMA = ("platform string, endpoint string, request_id string, keyword string, page_no int, "
          "status int, has_cookie boolean, body string")


def row(platform, endpoint, body, keyword="k", page=1, request_id="", status=200):
    text = body if isinstance(body, str) else json.dumps(body)
    return (platform, endpoint, request_id, keyword, page, status, True, text)


def mblog(i):
    return {"card_type": 9, "mblog": {"id": i, "text": "t", "user": {"id": 1}}}


PAYLOADS = [
    row("bili", "search", {"code": 0, "data": {"result": [
        {"result_type": "video", "data": [{"bvid": "BV2"}, {"bvid": "BV1"}]}]}}),
    row("bili", "search", {"code": 0, "data": {"result": [
        {"result_type": "video", "data": [{"bvid": "BV2"}, {"bvid": "BV3"}]}]}}, page=2),
    row("bili", "video", {"code": 0, "data": {"bvid": "BV1", "aid": 3}}, request_id="BV1"),
    row("bili", "comments", {"code": 0, "data": {"replies": [{"rpid": 1}, {"rpid": 2}]}},
        request_id="3"),
    row("zhihu", "search", {"data": [
        {"object": {"type": "answer", "id": "8", "question": {"id": "7"}}},
        {"object": {"type": "question", "id": "7"}}, {"object": {"type": "question", "id": "x"}},
        {"object": {"type": "article", "id": "9"}}]}),
    row("zhihu", "answers", {"data": [{"id": 8, "content": "c"}]}, request_id="7"),
    row("zhihu", "question", {"id": 7, "title": "q"}, request_id="7"),
    row("zhihu", "comments", {"data": [{"id": 5, "content": "c"}]}, request_id="8"),
    row("weibo", "search", {"ok": 1, "data": {"cards": [mblog(4), {
        "card_type": 11, "card_group": [mblog(5), mblog(4)]}]}}),
    row("weibo", "search", "<html>", keyword="other", status=418),
    row("tieba", "html_search", '<div class="s_post"><a href="/p/6">six</a></div>'),
    row("tieba", "forum", {"data": {"thread_list": [{"tid": 9, "title": "t"}, {"tid": 6}]}}),
]


@pytest.fixture
def landed(spark, tmp_path):
    return L.land(spark.createDataFrame(PAYLOADS, SCHEMA), str(tmp_path / "raw"))


@pytest.fixture
def links(spark, landed):
    return L.ingest_links(landed, spark.createDataFrame([], SCHEMAS["keyword_posts"]), AS_OF, 2)


def test_links_in_search_order(links, rows):
    assert rows(links, "keyword", "platform", "rank", "post_id") == [
        ("k", "bili", 1, "BV2"), ("k", "bili", 2, "BV1"), ("k", "tieba", 1, "9"),
        ("k", "tieba", 2, "6"), ("k", "weibo", 1, "4"), ("k", "weibo", 2, "5"),
        ("k", "zhihu", 1, "7")]
    assert set(links.columns) == set(SCHEMAS["keyword_posts"].fieldNames())


def test_seen_posts_get_no_second_link(landed, links, rows):
    again = L.ingest_links(landed, links, AS_OF + 9, 2)
    assert rows(again) == []
    third = L.ingest_links(landed, links, AS_OF + 9, 3)
    assert rows(third, "platform", "rank", "post_id") == [("bili", 1, "BV3")]
    assert L.ingest_links(landed, links, AS_OF + 9, 3, only_new=False).count() == 8


def test_runs_say_what_came_back(landed, links):
    runs = L.ingest_runs(landed, AS_OF, 2)
    done = L.close_ingested(runs, landed, links, normalize_batch(landed, AS_OF), AS_OF + 5)
    got = {(r.keyword, r.platform): (r.posts_fetched, r.comments_fetched, r.error)
           for r in done.collect()}
    # Answers and their comments count as comments of the question.
    assert got == {("k", "bili"): (1, 2, None), ("k", "zhihu"): (1, 2, None),
                   ("k", "weibo"): (2, 0, None), ("k", "tieba"): (2, 0, None),
                   ("other", "weibo"): (0, 0, "SoftBanned")}
    assert done.select("run_id").distinct().count() == 5
    assert {r.finished_at for r in done.collect()} == {AS_OF + 5}


def test_landed_payloads_are_read_by_partition(spark, landed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = normalize_batch(landed, AS_OF)["bili_comments"]._jdf.queryExecution().executedPlan()
    text = plan.toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert text.count("FileScan") == 1 and "try_parse_json" not in text
    for part in ("platform#[0-9]+ = bili", "endpoint#[0-9]+ = comments", "outcome#[0-9]+ = OK"):
        assert re.search(part, text.split("PartitionFilters: [")[1].split("]")[0])
    assert "body" not in text.split("ReadSchema:")[1]


def test_batch_in_bucketed_tables(spark, landed, tmp_path, rows):
    batch = normalize_batch(landed, AS_OF)
    batch = {t: batch[t] for t in ("bili_comments", "engagement_snapshots")}
    root = str(tmp_path / "tables")
    assert merge_batch(spark, root, batch, AS_OF, buckets=4) == {
        "bili_comments": 1, "engagement_snapshots": 1}
    once = {t: rows(buckets.read(spark, f"{root}/{t}")) for t in batch}
    merge_batch(spark, root, batch, AS_OF, buckets=4)
    assert {t: rows(buckets.read(spark, f"{root}/{t}")) for t in batch} == once
    assert len(once["bili_comments"]) == 2 and len(once["engagement_snapshots"]) > 0


def test_nothing_landed(spark):
    none = spark.createDataFrame([], SCHEMA)
    links = L.ingest_links(none, spark.createDataFrame([], SCHEMAS["keyword_posts"]), AS_OF, 2)
    assert links.count() == 0 and L.ingest_runs(none, AS_OF, 2).count() == 0


@pytest.mark.parametrize("reverse", [False, True])
def test_the_later_row_of_a_batch_counts(spark, rows, reverse):
    def video(title):
        return {"code": 0, "data": {"bvid": "BV1", "aid": 3, "title": title}}

    def replies(*messages):
        return {"code": 0, "data": {"replies": [
            {"rpid": 1, "content": {"message": m}} for m in messages]}}

    timed = [
        (*row("bili", "video", video("z old"), request_id="BV1"), 10),
        (*row("bili", "video", video("a new"), request_id="BV1"), 20),
        (*row("bili", "video", video("m mid"), request_id="BV1", page=9), 15),
        (*row("bili", "comments", replies("x", "b"), request_id="3", page=2), None),
        (*row("bili", "comments", replies("z", "y"), request_id="3"), None),
        (*row("zhihu", "answers", {"data": [{"id": 8, "voteup_count": 9}]}, request_id="7"), 5),
        (*row("zhihu", "answers", {"data": [{"id": 8, "voteup_count": 1}]}, request_id="7"), 6),
        (*row("weibo", "search", {"ok": 1, "data": {"cards": [mblog(4)]}}), 7),
        (*row("weibo", "status", {"ok": 1, "data": {"id": 4, "text": "shown"}}), 8),
        (*row("tieba", "thread", {"data": {"post_list": [{"id": 1, "title": "one"}]}},
              request_id="5"), 9),
        (*row("tieba", "thread", {"data": {"post_list": [{"id": 1, "title": "two"}]}},
              request_id="5"), 8),
    ]
    payloads = spark.createDataFrame(timed[::-1] if reverse else timed,
                                     SCHEMA + ", fetched_at bigint")
    got = normalize_batch(payloads, AS_OF)
    assert rows(got["bili_videos"], "title") == [("a new",)]
    assert rows(got["bili_comments"], "message") == [("b",)]
    assert rows(got["zhihu_answers"], "voteup_count") == [(1,)]
    assert rows(got["weibo_posts"], "text") == [("shown",)]
    assert rows(got["tieba_threads"], "title") == [("one",)]
