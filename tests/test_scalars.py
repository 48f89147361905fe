from pyspark.sql import functions as F

from hearsay.functions import scalars as S, times as T

AS_OF = 1718000000  # 2024-06-10 06:13:20 UTC


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.withColumn("v", fn(F.col("t"))).orderBy("i").collect()]


def test_post_times(spark):
    cases = {
        "刚刚": AS_OF,
        "5分钟前": AS_OF - 300,
        "2 小时前": AS_OF - 7200,
        "昨天 08:30": 1717921800,
        "昨天": AS_OF - 86400,
        "昨天 99:99": AS_OF - 86400,
        "Sat Sep 09 16:30:00 +0800 2023": 1694248200,
        "2023-09-09 10:11:12": 1694254272,
        "2023-9-9 10:11": 1694254260,
        "2023-09-09": 1694217600,
        "03-05 10:00": 1709632800,
        "02-29": 1709164800,
        "2023-02-29": None,
        "13-45": None,
        "junk": None,
        "": None,
    }
    got = values(spark, cases, lambda t: T.parse_post_time(t, F.lit(AS_OF)))
    assert dict(zip(cases, got)) == cases


def test_local_zone(spark):
    got = values(spark, ["2024-01-01 08:00", "昨天 00:00", "Mon Jan 01 08:00:00 +0800 2024"],
                 lambda t: T.parse_post_time(t, F.lit(AS_OF), 8 * 3600))
    assert got == [1704067200, 1717862400, 1704067200]


def test_times_do_not_depend_on_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        got = values(spark, ["2023-09-09"], lambda t: T.parse_post_time(t, F.lit(AS_OF)))
        text = spark.range(1).select(S.utc_text(F.lit(86399)), S.utc_day(F.lit(86399))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [1694217600]
    assert tuple(text) == ("1970-01-01 23:59:59", "1970-01-01")


def test_lenient_int(spark):
    texts = ["12", " 7 ", "-3", "1.2", "1.2万", "", None]
    assert values(spark, texts, S.lenient_int) == [12, 7, 0, 0, 0, 0, 0]
    json = ["1", '"12"', '"1.2"', "12.7", "true", "null", '"1.2万"', "{}"]
    got = values(spark, json, lambda t: S.lenient_int_variant(F.try_parse_json(t)))
    assert got == [1, 12, 0, 12, 0, 0, 0, 0]


def test_zero_or_missing(spark):
    df = spark.createDataFrame([(0, 5), (None, 5), (3, 5), (0, None)], "a int, b int")
    pick = lambda **kw: [r.v for r in df.select(
        S.first_present(F.col("a"), F.col("b"), **kw).alias("v")).collect()]
    assert pick() == [0, 5, 3, 0]
    assert pick(zero_is_missing=True) == [5, 5, 3, None]


def test_text_helpers(spark):
    assert values(spark, ["abc", "abcdef"], lambda t: S.shorten(t, 5)) == ["abc", "abcd…"]
    assert values(spark, ["a/b 中 文.x_-?", "//", "x" * 100], S.sanitize_keyword) == [
        "ab中文.x_-", "keyword", "x" * 80]
    row = spark.createDataFrame(
        [(" a ", "nan", None, "", "b\n")], "a string, b string, c string, d string, e string")
    assert row.select(S.row_text(*map(F.col, "abcde"))).first()[0] == "a b"
    assert spark.range(1).select(S.percent(F.lit(0.125))).first()[0] == "12.5%"


def test_urls_and_ids(spark):
    cases = {
        "https://www.bilibili.com/video/BV1xx411c7XW?p=1": ("bili_video", "BV1xx411c7XW", None),
        "https://www.zhihu.com/question/12/answer/34": ("zhihu_answer", "12", "34"),
        "https://www.zhihu.com/question/12": ("zhihu_question", "12", None),
        "https://zhuanlan.zhihu.com/p/9": ("zhihu_article", "9", None),
        "https://zhuanlan.zhihu.com/c_12ab": ("zhihu_column", "c_12ab", None),
        "https://m.weibo.cn/detail/77": ("weibo_post", "77", None),
        "https://weibo.com/12/AbC9": ("weibo_post", "AbC9", None),
        "https://tieba.baidu.com/p/5": ("tieba_thread", "5", None),
        "https://example.org": (None, None, None),
    }
    got = values(spark, cases, S.classify_url)
    assert dict(zip(cases, map(tuple, got))) == cases
    assert values(spark, ["BV1xx411c7XW", "bv12", " 42 ", "x"], S.classify_id) == [
        "bili_video", None, "zhihu_question", None]
