import pytest
from pyspark.sql import functions as F

from hearsay.operators import merge as G, worklist as W
from hearsay.operators.retrieve import Corpus
from hearsay.sources import sinks

BASE = [("a", "t", "x", 1), ("b", "u", None, 2)]


@pytest.fixture
def base(spark):
    return spark.createDataFrame(BASE, "id string, title string, tags string, fetched_at bigint")


def test_missing_column_is_not_null(spark, base, rows):
    upd = spark.createDataFrame([("a", "new", 9, 1), ("c", "z", 8, 1)],
                                "id string, title string, fetched_at bigint, seq bigint")
    assert rows(G.upsert(base, upd, ["id"], "seq")) == [
        ("a", "new", "x", 1), ("b", "u", None, 2), ("c", "z", None, 8)]


def test_explicit_null_overwrites_or_not(spark, base, rows):
    upd = spark.createDataFrame([("a", None, 1)], "id string, tags string, seq bigint")
    assert rows(G.upsert(base, upd, ["id"], "seq"))[0] == ("a", "t", None, 1)
    assert rows(G.upsert(base, upd, ["id"], "seq", null_overwrites=False))[0] == (
        "a", "t", "x", 1)


def test_upsert_is_idempotent_and_last_wins(spark, base, rows):
    upd = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1)],
                                "id string, title string, seq bigint")
    once = G.upsert(base, upd, ["id"], "seq")
    assert rows(once, "id", "title") == [("a", "2"), ("b", "3")]
    assert rows(G.upsert(once, upd, ["id"], "seq")) == rows(once)


def test_insert_ignore(spark, rows):
    key = ["platform", "post_id", "fetched_at"]
    schema = "platform string, post_id string, fetched_at bigint, v bigint"
    old = spark.createDataFrame([("p", "1", 5, 1)], schema)
    new = spark.createDataFrame([("p", "1", 5, 9), ("p", "1", 6, 3), ("p", "1", 6, 2)], schema)
    got = G.insert_ignore(old, new, key, ["v"])
    assert rows(got) == [("p", "1", 5, 1), ("p", "1", 6, 2)]
    assert rows(G.insert_ignore(got, new, key, ["v"])) == rows(got)


def test_run_ledger(spark):
    asked = spark.createDataFrame([("k", "bili", 10, 100, "{}")],
                                  "keyword string, platform string, requested_count bigint, "
                                  "started_at bigint, config string")
    runs = G.open_runs(asked)
    run_id = runs.first().run_id
    assert G.open_runs(asked).first().run_id == run_id
    done = spark.createDataFrame([(run_id, 160, 3, 4, None)],
                                 "run_id bigint, finished_at bigint, posts_fetched bigint, "
                                 "comments_fetched bigint, error string")
    r = G.close_runs(runs, done).first()
    assert (r.finished_at, r.posts_fetched, r.keyword, r.started_at) == (160, 3, "k", 100)


def hits(spark, *ids):
    return spark.createDataFrame([("k", "bili", i, 1, n) for n, i in enumerate(ids)],
                                 "keyword string, platform string, post_id string, page_no int, "
                                 "pos int")


def test_worklist_caps_before_dropping_seen(spark, rows):
    found = hits(spark, "a", "b", "a", "c", None, "", "d", "e")
    seen = spark.createDataFrame([("k", "bili", "b"), ("k", "weibo", "a")],
                                 "keyword string, platform string, post_id string")
    order = ["page_no", "pos"]
    assert rows(W.worklist(found, seen, 3, order), "post_id", "rank") == [("a", 1), ("c", 2)]
    assert rows(W.worklist(found, seen, 3, order, only_new=False), "post_id", "rank") == [
        ("a", 1), ("b", 2), ("c", 3)]
    assert rows(W.worklist_skipped(found, seen, 3, order), "capped", "skipped", "kept") == [
        (3, 1, 2)]


def test_hits_to_parents(spark, rows):
    found = spark.createDataFrame(
        [("k", "question", "5", None, 0), ("k", "answer", "9", "7", 1),
         ("k", "people", "3", None, 2), ("k", "question", "x", None, 3),
         ("k", "answer", "8", "5", 4), ("k", "question", "6", None, 5)],
        "keyword string, kind string, target_id string, parent_id string, pos int")
    assert rows(W.hits_to_parents(found, 2, ["pos"]), "question_id", "rank") == [(5, 1), (7, 2)]


def test_outcomes(spark, rows):
    items = spark.createDataFrame(
        [(1, "ok", None), (1, "failed", "NotFound"), (1, "failed", "SoftBanned"),
         (1, "failed", "SoftBanned"), (1, "skipped", None)],
        "run_id int, outcome string, error string")
    assert rows(W.run_outcomes(items)) == [(1, 5, 1, 3, 1)]
    assert [tuple(r) for r in W.run_error_tally(items).collect()] == [
        (1, "SoftBanned", 2), (1, "NotFound", 1)]


def test_csv_keeps_quotes_newlines_and_nulls(spark, tmp_path, rows):
    df = spark.createDataFrame([('a "q", b', "x\ny", None), ("中文", "", "z")],
                               "a string, b string, c string")
    sinks.export_csv(df, str(tmp_path / "c"), bom=True)
    part = next((tmp_path / "c").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfa,b,c")
    import csv
    import io
    texts = [p.read_text("utf-8-sig") for p in (tmp_path / "c").glob("part-*.csv")]
    got = sorted(r for t in texts for r in list(csv.reader(io.StringIO(t)))[1:])
    assert got == [['a "q", b', "x\ny", ""], ["中文", "", "z"]]


def test_export_run(spark, tmp_path):
    from tests.test_model import table
    from hearsay.schema import SCHEMAS
    t = {n: table(spark, n) for n in SCHEMAS}
    t["weibo_posts"] = table(spark, "weibo_posts", dict(id="1", text="w"))
    t["keyword_posts"] = table(spark, "keyword_posts", dict(
        keyword="电动车?", platform="weibo", post_id="1", run_id=4, rank=1))
    t["scrape_runs"] = table(spark, "scrape_runs", dict(
        run_id=4, keyword="电动车?", platform="weibo"))
    c = Corpus.from_tables(t)
    paths = sinks.export_run(c, 4, str(tmp_path))
    assert set(paths) == {"posts"} and paths["posts"].endswith("/电动车_run4_posts.csv")
    assert spark.read.option("header", True).csv(paths["posts"]).columns[1] == "帖子ID"
    with pytest.raises(ValueError):
        sinks.export_run(c, 5, str(tmp_path))
    paths = sinks.export_all_runs(c, str(tmp_path / "all"), chinese=False)
    assert set(paths) == {"posts", "comments"}
    back = spark.read.option("header", True).csv(paths["posts"])
    first = next((tmp_path / "all").rglob("posts.csv/*/*/part-*.csv"))
    assert first.read_bytes().startswith(sinks.BOM.encode())
    row = back.first()
    assert row.keyword_key.startswith("电动车-") and (row.run_id, row.post_id) == (4, "1")


def test_json_dump(spark, tmp_path):
    df = spark.createDataFrame([("中", None)], "a string, b string")
    row = sinks.json_rows({"t": df}).first()
    assert (row.table_name, row.row) == ("t", '{"a":"中","b":null}')
    sinks.export_json({"t": df}, str(tmp_path))
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("*.json"))
    assert text.strip() == '{"a":"中","b":null}'


def test_lists_to_json(spark):
    df = spark.createDataFrame([(["a", "中"], 1)], "t array<string>, n int")
    assert G.lists_to_json(df).first().t == '["a","中"]'
    assert G.evolve(df.select("n"), spark.createDataFrame([], "n bigint, x string").schema
                    ).first().asDict() == {"n": 1, "x": None}


def test_seen(spark, rows):
    links = spark.createDataFrame([("k", "bili", "1"), ("k", "bili", "1"), ("k", "bili", None),
                                   ("q", "bili", "2")],
                                  "keyword string, platform string, post_id string")
    assert rows(G.seen_post_ids(links, "k", "bili"), "post_id") == [("1",)]
    assert G.seen_post_ids(links).where(F.col("keyword") == "q").count() == 1
