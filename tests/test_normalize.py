"""Golden payloads, one per job, with the gaps and odd types that occur."""

import json

import pytest
from pyspark.sql import functions as F

from hearsay.normalize import bili, common, responses, tieba, weibo, zhihu
from hearsay.plans.ingest import apply_batch, normalize_batch, save_tables
from hearsay.schema import SCHEMAS
from tests.test_model import table

AS_OF = 1718000000


@pytest.fixture
def payload(spark):
    def make(schema, *items):
        data = [(*keys, body if isinstance(body, str) else json.dumps(body, ensure_ascii=False))
                for *keys, body in items]
        return spark.createDataFrame(data, f"{schema}, body string" if schema else "body string")
    return make


def test_video(payload):
    p = payload("", ({"data": {"bvid": "BV1", "aid": 3, "title": "t", "owner": {"mid": "5"},
                               "stat": {"view": 9, "like": 0}}},), ("not json",))
    r = bili.norm_video(p).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.desc, r.pubdate, r.duration, r.owner_mid, r.owner_name) == ("", 0, 0, 5, None)
    assert (r.view, r.like, r.coin, r.tags) == (9, 0, None, None)
    assert json.loads(r.raw)["aid"] == 3


def test_tags(payload):
    p = payload("aid bigint", (3, {"data": [{"tag_name": "a"}, {"tag_name": ""}, {}]}),
                (4, {"data": None}))
    assert {r.aid: r.tags for r in bili.norm_tags(p).collect()} == {3: ["a"], 4: []}


def test_video_comments(payload, rows):
    p = payload("oid bigint, page_no int",
                (3, 1, {"data": {"replies": [
                    {"rpid": 1, "mid": 2, "member": None, "content": {"message": "m"}},
                    {"rpid": 2, "parent": 1, "like": 4}]}}), (3, 2, {"data": None}))
    assert rows(bili.norm_comments(p), "rpid", "parent", "uname", "message", "likes") == [
        (1, 0, None, "m", None), (2, 1, None, None, 4)]


def test_dynamics(payload, rows):
    archive = {"type": "MAJOR_TYPE_ARCHIVE", "archive": {"bvid": "BV9", "title": "vt"}}
    p = payload("", ({"data": {"items": [
        {"id_str": "11", "modules": {"module_author": {"mid": 1, "pub_ts": 5},
                                     "module_dynamic": {"desc": {"text": ""}, "major": archive}}},
        {"id": 12, "modules": {"module_dynamic": {
            "desc": {"text": "said"}, "major": {"type": "MAJOR_TYPE_DRAW",
                                                "archive": {"bvid": "no"}}},
            "module_stat": {"like": {"count": 0}}}},
        {"modules": None}]}},))
    assert rows(bili.norm_dynamics(p), "dynamic_id", "text", "bvid", "like_count", "pub_ts") == [
        ("11", "vt", "BV9", None, 5), ("12", "said", None, 0, None)]


def test_search_rank_runs_over_pages(payload, rows):
    def page(*ids):
        return {"data": {"result": [{"result_type": "user", "data": [{"bvid": "u"}]},
                                    {"result_type": "video", "data": [
                                        {"bvid": i, "title": f'<em class="keyword">{i}</em>!',
                                         "play": "--"} for i in ids]},
                                    {"result_type": "video", "data": [{"bvid": "second"}]}]}}
    p = payload("keyword string, page_no int", ("k", 2, page("c")), ("k", 1, page("a", "b")),
                ("k", 3, {"data": {}}), ("z", 1, page("x")))
    assert rows(bili.norm_search(p), "keyword", "bvid", "title", "rank", "play") == [
        ("k", "a", "a!", 1, None), ("k", "b", "b!", 2, None), ("k", "c", "c!", 3, None),
        ("z", "x", "x!", 1, None)]


def test_question(payload):
    p = payload("question_id bigint",
                (5, {"title": "q", "detail": "<p>a</p><p>b</p>", "visit_count": 0,
                     "topics": [{"name": "n"}, {"title": "t"}, 77, "s", {}]}),
                (6, {"id": 66, "topics": []}))
    by_id = {r.id: r for r in zhihu.norm_question(p).collect()}
    assert by_id[5].detail == "a\nb" and by_id[5].view_count == 0
    assert by_id[5].topics == ["n", "t", "77", "s"]
    assert by_id[66].topics is None and by_id[66].detail == ""


def test_general_search(payload, rows):
    p = payload("keyword string, page_no int", ("k", 1, {"data": [
        {"type": "search_result", "object": {"type": "question", "id": 5, "title": "q",
                                             "excerpt": "", "excerpt_new": "<em>e</em>"}},
        {"type": "x", "object": {"type": "answer", "id": "8", "question": {"id": 5, "title": "p"}}},
        {"id": 3}, {"type": "people", "object": {"name": "who"}}]}))
    assert rows(zhihu.norm_general_search(p), "pos", "kind", "target_id", "title", "excerpt",
                "parent_id") == [
        (0, "question", "5", "q", "e", None), (1, "answer", "8", "p", "", "5"),
        (2, "unknown", "3", "", "", None), (3, "people", "", "who", "", None)]


def test_articles_and_columns(payload, rows):
    art = {"id": 1, "column": {"id": "own"}, "content": "<b>c</b>", "voteup_count": 2}
    assert rows(zhihu.norm_article(payload("", (art,), ({"title": "no id"},))),
                "id", "column_id", "content") == [(1, "own", "c")]
    listed = payload("column_id string", ("given", {"data": [art]}))
    assert rows(zhihu.norm_column_items(listed), "id", "column_id") == [(1, "given")]
    col = payload("column_id string", ("c1", {"title": "t", "description": "<i>d</i>"}))
    assert rows(zhihu.norm_column(col), "id", "title", "description") == [("c1", "t", "d")]


def test_embedded_state(spark, rows):
    state = {"initialState": {"entities": {
        "questions": {"5": {"id": 5, "title": "q", "answerCount": 0, "answer_count": 3,
                            "topicIds": [1, "2", {"name": "obj"}]}},
        "topics": {"1": {"name": "one"}},
        "answers": {
            "9": {"id": 9, "question": {"id": 5}, "voteupCount": 1, "content": "<p>x</p>"},
            "8": {"id": 8, "question": {"id": 5}},
            "7": {"id": 7, "question": {"id": "5"}, "voteupCount": 4, "commentCount": 0,
                  "comment_count": 6},
            "6": {"id": 6, "question": {"id": 4}, "voteupCount": 100}}}}}
    page = f'<html><script id="js-initialData" type="x">{json.dumps(state)}</script></html>'
    pages = spark.createDataFrame([(5, page), (6, page), (7, "<html></html>"),
                                   (8, '<script id="js-initialData">{bad</script>')],
                                  "question_id bigint, html string")
    q = zhihu.embedded_questions(pages).collect()
    assert [(r.id, r.answer_count, r.topics) for r in q] == [(5, 0, ["one", "2", "obj"])]
    assert zhihu.embedded_questions(pages, zero_is_missing=True).first().answer_count == 3
    assert rows(zhihu.embedded_answers(pages, 2), "id", "voteup_count", "comment_count") == [
        (7, 4, 0), (9, 1, None)]
    faithful = zhihu.embedded_answers(pages, 3, zero_is_missing=True)
    assert rows(faithful, "id", "comment_count") == [(7, 6), (8, None), (9, None)]


def test_answer_comments(payload, rows):
    p = payload("answer_id bigint", (8, {"data": [
        {"id": 1, "like_count": 0, "vote_count": 5, "content": "a"}, {"vote_count": 2},
        {"id": 3, "vote_count": 2}]}))
    assert rows(zhihu.norm_answer_comments(p), "comment_id", "like_count") == [(1, 0), (3, 2)]
    assert rows(zhihu.norm_answer_comments(p, 1, zero_is_missing=True), "comment_id",
                "like_count") == [(1, 5)]


def mblog(i, **kw):
    return {"id": i, "user": {"id": 4, "screen_name": "n"}, "text": "<a>hi</a> you",
            "created_at": "刚刚", "attitudes_count": 3, "comments_count": "12",
            "reposts_count": "1.2万"} | kw


def test_cards_and_posts(payload, rows):
    cards = [{"card_type": 9, "mblog": mblog(1), "card_group": [
                 {"card_type": 9, "mblog": mblog(None, mid="2")}, {"card_type": 4}]},
             {"card_type": 11, "card_group": [{"card_type": 9, "mblog": mblog(3)}]},
             {"card_type": 9}, {"card_type": 9, "mblog": None}, {"card_type": 4,
                                                                  "mblog": mblog(5)}]
    p = payload("keyword string, page_no int", ("k", 1, {"data": {"cards": cards}}),
                ("k", 2, {"data": {}}))
    found = weibo.norm_cards(p)
    assert rows(found, "card", "member") == [(0, 0), (0, 1), (1, 1)]
    posts = weibo.norm_micropost(found, AS_OF)
    assert rows(posts, "id", "text", "created_ts", "attitudes_count", "comments_count",
                "reposts_count") == [(i, "hi you", AS_OF, 3, 12, 0) for i in ("1", "2", "3")]


def test_long_text(spark, payload, rows):
    posts = spark.createDataFrame([("1", "s", True), ("2", "s", True), ("3", "s", False)],
                                  "id string, text string, is_long boolean")
    full = payload("id string", ("1", {"data": {"longTextContent": "<b>full</b>"}}),
                   ("2", {"data": {"longTextContent": ""}}),
                   ("3", {"data": {"longTextContent": "unused"}}))
    assert rows(weibo.long_text_override(posts, full), "id", "text") == [
        ("1", "full"), ("2", "s"), ("3", "s")]


def test_hotflow_cap_spans_pages(payload, rows):
    def page(*ids):
        return {"ok": 1, "data": {"data": [{"id": i, "like_count": None} for i in ids]}}
    p = payload("post_id string, page_no int", ("p", 2, page(3, 4)), ("p", 1, page(1, "", 2)),
                ("q", 1, {"ok": 0, "data": {"data": [{"id": 9}]}}))
    assert rows(weibo.norm_hotflow(p, AS_OF, 3), "comment_id", "like_count") == [
        ("1", 0), ("2", 0), ("3", 0)]


def test_forum_feed(payload, rows):
    def page(*threads, **kw):
        return {"errno": 0, "data": {"forum": {"name": "f"}, "thread_list": list(threads)} | kw}
    p = payload("keyword string, page_no int",
                ("k", 1, page({"tid": 1, "title": "a", "create_time": 0, "reply_num": "4"},
                              {"id": 2, "is_top": 1}, {"title": "no id"})),
                ("k", 2, page({"tid": 1, "title": "again"}, {"id": 3, "create_time": 7,
                                                             "author": {"name_show": "s"}})),
                ("k", 3, page()), ("k", 4, page({"tid": 4})),
                ("z", 1, page({"tid": 9}, forum={"is_exists": 0})))
    assert rows(tieba.norm_forum_feed(p), "keyword", "tid", "title", "reply_num", "created_ts",
                "author_name") == [
        ("k", "1", "a", 4, None, ""), ("k", "3", "", 0, 7, "s")]


def test_thread_and_floors(spark, payload, rows):
    hit = {c: None for c in tieba.HIT_COLUMNS}
    hits = spark.createDataFrame(
        [tuple((hit | h)[c] for c in tieba.HIT_COLUMNS) for h in [
            dict(tid="1", title="hit", excerpt="ex", forum_name="hf", author_name="ha",
                 reply_num=2, created_ts=5),
            dict(tid="2", title="hit2", excerpt="ex2", reply_num=8, created_ts=6),
            dict(tid="3", title="hit3", reply_num=0)]],
        "tid string, title string, excerpt string, forum_name string, author_name string, "
        "author_id string, reply_num bigint, created_at string, created_ts bigint")
    posts = [{"id": 10, "title": "op", "content": [{"text": "x<br/>"}, "y", {"type": 3}],
              "time": 9, "author": {"name": "", "name_show": "shown", "portrait": "pp"}},
             {"id": 11, "floor": 2, "content": "plain <b>t</b>", "time": 0}, {"floor": 3},
             {"post_id": 12, "floor": 4}]
    good = {"data": {"thread": {"replyNum": 40}, "forum": {"name": "df"}, "post_list": posts}}
    p = payload("tid string", ("1", good), ("2", {"errno": 4, "data": good["data"]}),
                ("3", "<html>"))
    got = {r.tid: r for r in tieba.norm_thread(hits, p, 5).collect()}
    one = got["1"]
    assert (one.title, one.author_name, one.author_id, one.forum_name, one.content) == (
        "op", "shown", "pp", "df", "x y")
    assert (one.reply_num, one.created_ts, one.url) == (40, 9, "https://tieba.baidu.com/p/1")
    assert (got["2"].title, got["2"].content, got["2"].reply_num, got["2"].created_ts) == (
        "hit2", "ex2", 8, 6)
    assert (got["3"].title, got["3"].reply_num, got["3"].content) == ("hit3", 0, "")
    assert rows(tieba.norm_floors(p, 5), "pid", "floor", "content", "created_ts") == [
        ("11", 2, "plain t", None), ("12", 4, "", None)]
    assert rows(tieba.norm_floors(p, 1), "pid") == [("11",)]


def test_search_pages(spark, rows):
    blocks = """<div class="s_post"><span class="p_title"><a href="/p/1?x=1">One <em>1</em></a>
      </span><div class="p_content">con <b>tent</b></div><a class="p_forum" href="/f?kw=a">F</a>
      <a href="/home/main?u=1">Au</a><font class="p_date">2024</font></div>
      <div class='s_post'><a href='/p/1'>dup</a></div>
      <div class="s_post_top"></div><div class="s_post"><a href="/x">no thread</a></div>"""
    plain = '<a href="/p/7">seven</a><a href="/p/7">again</a><a href="/p/8"> </a><a href="/q">z</a>'
    pages = spark.createDataFrame([(1, blocks), (2, plain)], "page_id int, html string")
    assert rows(tieba.parse_search_html(pages), "page_id", "tid", "title", "excerpt",
                "forum_name", "author_name", "created_at") == [
        (1, "1", "One1", "con tent", "F", "Au", "2024"), (2, "7", "seven", "", "", "", "")]


def test_pages_until_empty(spark, rows):
    pages = spark.createDataFrame(
        [("a", 1, 3, False), ("a", 2, 0, False), ("a", 3, 5, False), ("b", 1, 1, True),
         ("b", 2, 1, False), ("c", 1, 1, False)], "k string, page_no int, n int, is_end boolean")
    kept = common.pages_until_empty(pages, ["k"], F.col("n") == 0, F.col("is_end"))
    assert rows(kept, "k", "page_no") == [("a", 1), ("b", 1), ("c", 1)]


@pytest.mark.parametrize("platform, endpoint, page, status, cookie, body, outcome", [
    ("bili", "video", 1, 200, True, '{"code": -101}', "CookieExpired"),
    ("bili", "video", 1, 200, True, "[1]", "ParseError"),
    ("bili", "search", 2, 200, True, '{"code": 0}', "OK"),
    ("bili", "video", 1, 429, True, "", "RateLimited"),
    ("zhihu", "question", 1, 200, True, '{"id": 1}', "OK"),
    ("weibo", "search", 1, 200, True, '{"ok": -100}', "SoftBanned"),
    ("weibo", "comments", 1, 432, True, "", "SoftBanned"),
    ("tieba", "forum", 1, 412, False, "", "SoftBanned"),
    ("tieba", "html_search", 1, 200, False, "<html></html>", "SoftBanned"),
    ("tieba", "html_search", 1, 200, False, '<a href="/p/1">', "OK"),
])
def test_response_classes(spark, platform, endpoint, page, status, cookie, body, outcome):
    df = spark.createDataFrame([(platform, endpoint, page, status, cookie, body)],
                               "platform string, endpoint string, page_no int, status int, "
                               "has_cookie boolean, body string")
    assert responses.classify(df).first().outcome == outcome


def test_ingest_end_to_end_is_idempotent(spark, tmp_path, rows):
    def row(platform, endpoint, request_id, body, keyword="k", page=1, status=200):
        text = body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)
        return (platform, endpoint, request_id, keyword, page, status, True, text)
    payloads = spark.createDataFrame([
        row("bili", "video", "BV1", {"code": 0, "data": {
            "bvid": "BV1", "aid": 3, "title": "t", "stat": {"view": 5}}}),
        row("bili", "tags", "3", {"code": 0, "data": [{"tag_name": "x"}]}),
        row("bili", "comments", "3", {"code": 0, "data": {"replies": [{"rpid": 1}]}}),
        row("bili", "comments", "3", {"code": 0, "data": {"replies": [{"rpid": 1}]}}, page=2),
        row("bili", "video", "BV2", {"code": -404}),
        row("zhihu", "answers", "7", {"data": [{"id": 8, "content": "c"}]}),
        row("weibo", "search", "k", {"ok": 1, "data": {"cards": [
            {"card_type": 9, "mblog": mblog(1, isLongText=True)}]}}),
        row("weibo", "extend", "1", {"data": {"longTextContent": "full"}}),
        row("tieba", "thread", "5", {"data": {"post_list": [
            {"id": 1, "title": "op"}, {"id": 2, "floor": 2}]}}),
    ], "platform string, endpoint string, request_id string, keyword string, page_no int, "
       "status int, has_cookie boolean, body string")
    batch = normalize_batch(payloads, AS_OF)
    base = {n: table(spark, n) for n in SCHEMAS}
    once = apply_batch(base, batch, AS_OF)
    assert rows(once["bili_videos"], "bvid", "view", "tags", "fetched_at") == [
        ("BV1", 5, '["x"]', AS_OF)]
    assert rows(once["bili_comments"], "rpid", "oid") == [(1, 3)]
    assert rows(once["zhihu_answers"], "id", "question_id") == [(8, 7)]
    assert rows(once["weibo_posts"], "id", "text") == [("1", "full")]
    assert rows(once["tieba_threads"], "tid", "title", "reply_num") == [("5", "op", 1)]
    assert rows(once["tieba_comments"], "pid", "tid") == [("2", "5")]
    assert rows(once["engagement_snapshots"], "platform", "post_id") == [
        ("bili", "BV1"), ("tieba", "5"), ("weibo", "1")]
    saved = save_tables({t: once[t] for t in ("bili_videos", "engagement_snapshots")},
                        str(tmp_path), "1")
    stored = base | {t: spark.read.parquet(f"{saved}/{t}")
                     for t in ("bili_videos", "engagement_snapshots")}
    twice = apply_batch(stored, batch, AS_OF)
    for t in ("bili_videos", "engagement_snapshots"):
        assert rows(twice[t]) == rows(once[t])


def test_steps_of_a_post_time_and_of_an_embedded_page_are_computed_once(spark):
    from hearsay.functions.times import parse_post_time

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    times = spark.createDataFrame([(" 5分钟前 ",)], "t string").select(
        parse_post_time(F.upper("t"), F.lit(1718000000)).alias("v"))
    assert times.first().v == 1717999700 and plan(times).count("upper(") == 1
    pages = spark.createDataFrame([(7, "x"), (8, None)], "question_id bigint, html string")
    # The filter on the page's own question does not read the page a second time.
    assert plan(zhihu.embedded_questions(pages)).count("initialState,StructType") == 1
