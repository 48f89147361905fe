"""Reports, and what the physical plans of the analytic queries must not contain."""

import re

import pytest

import __spark_entry__ as entry
from catalog.fixtures import CLAUSES, LETTER, TOKEN_REGEX, Fixtures
from catalog.registry import ORACLES, QUERIES
from hearsay.functions.text import regex_tokenizer
from hearsay.operators import metrics, sentiment
from hearsay.plans.report import all_keywords_report, keyword_report

SF = "/root/testdata/sf0.001"
# They run streams or write files before a plan can be shown, or are Python by nature.
SKIP = {n for n in QUERIES if n.startswith(("stream_", "export_"))}
# A tag stack (also of the result pages of a batch) and a word graph are read by an Arrow UDF.
BY_UDF = {"parse_search_html", "parse_search_html_nested", "tokenize_best_path",
          "tokenize_max_match", "ingest_links", "ingest_runs", "ingest_volume_by_day"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](Fixtures(spark, SF)))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)
    python = re.findall(r"ArrowEvalPython|BatchEvalPython|InPandas|InArrow", text)
    assert set(python) == ({"ArrowEvalPython"} if name in BY_UDF else set())
    spark.catalog.clearCache()


def test_filters_and_columns_reach_the_scan(spark):
    f = Fixtures(spark, SF)
    text = plan(metrics.volume_by_day(f.corpus, "1-URGENT"))
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)" in text
    for schema in re.findall(r"ReadSchema: struct<([^>]*)", text):
        assert "c_name" not in schema and "p_name" not in schema and "l_tax" not in schema


def test_scoring_shuffles_texts_once(spark):
    f = Fixtures(spark, SF)
    scored = sentiment.score_texts(f.documents, ["doc_id"], "text", f.lexicon,
                                   regex_tokenizer(TOKEN_REGEX), CLAUSES)
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(scored))
    assert sum(s.startswith("doc_id") for s in shuffles) == 1


@pytest.mark.parametrize("days", [None, 5])
def test_keyword_report(spark, tmp_path, days):
    f = Fixtures(spark, SF)
    as_of = 1704067200 + 10 * 86400
    report = keyword_report(f.texts, "en", f.lexicon, days, as_of, regex_tokenizer(TOKEN_REGEX),
                            CLAUSES, must_contain=LETTER)
    assert set(report.tables) >= {"overview", "volume_by_day", "sentiment_summary", "hot_words",
                                  "samples", "engagement_distribution"}
    report.write(str(tmp_path / "r"), chinese=True)
    overview = spark.read.parquet(str(tmp_path / "r" / "overview")).first()
    summary = spark.read.parquet(str(tmp_path / "r" / "sentiment_summary"))
    assert "样本数" in summary.columns and summary.first()["情感倾向"] in ("正面", "中性", "负面")
    s = report.tables["sentiment_summary"].first()
    assert s.n == s.pos + s.neu + s.neg
    by_day = report.tables["sentiment_by_day"].collect()
    assert sum(r.n for r in by_day) == s.n
    assert sum(r.n for r in report.tables["sentiment_breakdown"].collect()) == s.n
    if days:
        full = keyword_report(f.texts, "en", f.lexicon, None, None,
                              regex_tokenizer(TOKEN_REGEX), CLAUSES)
        assert overview["帖子数"] < full.tables["overview"].first().n_posts
        full.release()
    report.release()
    with pytest.raises(ValueError):
        keyword_report(f.texts, "en", f.lexicon, days=3)


def test_all_keywords_equal_single_keywords(spark, rows):
    f = Fixtures(spark, SF)
    tok = regex_tokenizer(TOKEN_REGEX)
    report = all_keywords_report(f.texts, f.lexicon, tok, CLAUSES)
    summary = report.tables["sentiment_summary"]
    for keyword in ("en", "de"):
        one = sentiment.sentiment_summary(
            sentiment.scored_units(f.texts, keyword, f.lexicon, tokenizer=tok,
                                   clause_regex=CLAUSES))
        assert rows(summary.where(summary.keyword == keyword).drop("keyword")) == rows(one)
    volume = report.tables["volume_by_day"].where("keyword = 'fr'").drop("keyword")
    assert rows(volume) == rows(metrics.volume_by_day(f.texts, "fr"))


def test_every_query_has_an_oracle_but_the_dump():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == {"export_json_rows"}


def test_merge_moves_only_the_updates(spark, tmp_path):
    from pyspark.sql import functions as F

    from hearsay.operators.merge import upsert

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = spark.range(2000).select(
            F.col("id").cast("string").alias("id"), F.lit("t").alias("title"),
            F.col("id").alias("fetched_at"))
        base.write.bucketBy(8, "id").sortBy("id").option("path", f"{tmp_path}/base").saveAsTable(
            "merge_base", mode="overwrite")
        updates = spark.range(50).select(
            (F.col("id") * 3).cast("string").alias("id"), F.lit("new").alias("title"),
            F.lit(9).alias("fetched_at"), F.col("id").alias("seq"))
        out = upsert(spark.table("merge_base"), updates, ["id"], "seq")
        plan = out._jdf.queryExecution().executedPlan().toString()
        initial = plan.split("Initial Plan")[-1]
        scan = initial[: initial.index("merge_base")]
        # Above the scan of the base up to the join there is no exchange.
        assert "Exchange" not in scan.split("SortMergeJoin")[-1]
        got = {r.id: (r.title, r.fetched_at) for r in out.collect()}
        assert len(got) == 2000 and got["3"] == ("new", 3) and got["1"] == ("t", 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS merge_base")
