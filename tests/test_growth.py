"""Steps whose cost must not grow faster than their input."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

import catalog.all  # noqa: F401
from catalog.fixtures import Fixtures
from catalog.registry import QUERIES
from hearsay.functions import text as X
from hearsay.operators import hotwords, sentiment as N
from hearsay.sources import sinks
from hearsay.streaming import snapshots as S

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_texts_are_cut_apart():
    assert X._parts(["ab", "c"], False) == "[ab]+|[^ab]"
    assert X._parts([], False) == "(?s:.)"
    assert "Z" in X._parts(["ab"], True)


def test_frequent_words_are_spread_over_salts(spark):
    f = Fixtures(spark, SF)
    scored = N.score_texts(f.documents, ["doc_id"], "text", f.lexicon)
    assert "_salt" in plan(scored)


def test_the_dump_computes_posts_and_comments_once(spark):
    text = plan(sinks.json_rows(Fixtures(spark, SF).stored("fx_base", "fx_comments").tables))
    assert "l_orderkey" not in text


def test_all_runs_are_written_where_they_are_joined(spark, tmp_path):
    f = Fixtures(spark, SF)
    paths = sinks.export_all_runs(f.corpus, str(tmp_path), chinese=False, compression="gzip")
    assert list(tmp_path.rglob("comments.csv/*/*/part-*.csv.gz"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert set(paths) == {"posts", "comments"}


def test_a_timed_key_is_one_read_and_one_write():
    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    day = S.DayOfSnapshots(False)
    day.state = State()
    rows = [{"fetched_at": at} | dict.fromkeys(S.COUNTERS, at) for at in (5, 3, 5)]
    out = list(day.handleInputRows(("p", "1", 0), iter(rows), None))
    assert [(r.fetched_at, r.seconds, r.opens) for r in out] == [(3, None, True), (5, 2, False)]
    assert day.state.calls == 2 and day.state.value[0] == 1
    assert [r[0] for r in json.loads(day.state.value[1])] == [3, 5]


def test_words_are_cut_once_for_totals_and_weights(spark):
    """The tokenizer stands once in the plan of the counts; the keywords' plan has none."""
    df = spark.createDataFrame([("bb aa bb",), ("aa cc",), (None,), (" ",)], "text string")
    counts = hotwords.word_counts(df, "text")
    assert plan(counts).count("regexp_extract_all") == 1
    assert sorted(map(tuple, counts.collect())) == [
        ("", 2, 2), ("aa", 2, 2), ("bb", 2, 1), ("cc", 1, 1)]
    top = hotwords.top_keywords(counts, 5, must_contain="[a-z]")
    assert "regexp_extract_all" not in plan(top)
    weights = {"aa": 2 / 5 * math.log(3 / 3), "bb": 2 / 5 * math.log(3 / 2),
               "cc": 1 / 5 * math.log(3 / 2)}
    assert {r.word: r.weight for r in top.collect()} == pytest.approx(weights, abs=1e-9)


SMALL = [("positive", "good", 1.0), ("degree", "very", 2.0), ("negation", "no", 1.0)]


def small_scores(spark, rows, **options):
    units = spark.createDataFrame(rows, "id int, text string, lang string")
    lex = spark.createDataFrame(SMALL, "bucket string, term string, value double")
    return N.score_texts(units, ["id"], "text", lex, clause_regex="[.,]", keep=["lang"],
                         **options)


def test_a_unit_is_summed_where_it_is_read(spark):
    """No hit is shuffled or sorted, and a text is cut once."""
    scored = small_scores(spark, [(1, "no x very good. good", "a"), (2, None, "b"), (3, "", "c"),
                                  (None, "very, good", "d")])
    text = plan(scored)
    assert "Window" not in text and "Repartition" not in text
    assert text.count("regexp_extract_all") == 1
    assert {r.id: (r.lang, round(r.raw, 9), r.pos_hits, r.neg_hits) for r in scored.collect()} == {
        1: ("a", -0.4, 1, 1), 2: ("b", 0, 0, 0), 3: ("c", 0, 0, 0), None: ("d", 1, 1, 0)}


def test_rows_of_one_key_are_one_unit(spark):
    """Their hits are merged by position; the other units are summed alone."""
    scored = small_scores(spark, [
        (1, "no x good", "a"), (1, "no x good", "a"),  # two negations cancel, then good stops
        (2, "no x good", "b"), (3, "very", "c"), (3, "x good", "c"),
        (None, "good", "d"), (None, "good", "d"), (None, None, "d")])
    assert {r.id: (r.lang, round(r.raw, 9), r.pos_hits, r.neg_hits) for r in scored.collect()} == {
        1: ("a", 2, 2, 0), 2: ("b", -0.7, 0, 1), 3: ("c", 2, 1, 0), None: ("d", 2, 2, 0)}


def test_a_large_lexicon_moves_tokens_alone(spark):
    """A token that is shuffled to the lexicon does not take the tokens before it along."""
    rows = [(1, "no x very good. good", "a"), (2, "no x good", "b"), (3, "", "c")]
    few, many = (small_scores(spark, rows, large_lexicon=x) for x in (False, True))
    assert "arrays_zip" in plan(few) and "arrays_zip" not in plan(many)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_a_post_is_read_once(spark):
    """One typed read of the cards and one of each post; lines are collected, not whole cards."""
    text = plan(QUERIES["norm_micropost"](Fixtures(spark, SF)))
    assert len(re.findall(r"\$, StructField\(id", text)) == 1
    assert len(re.findall(r"\$\.data\.cards, ArrayType\(StructType", text)) == 1
    assert not re.search(r"\$\.(?:id|card_type|card_group|mblog|text),", text)
    assert "collect_list(named_struct(at" not in text


def test_posts_of_odd_cards(spark, rows):
    """Fields of unexpected types are read as paths read them."""
    from hearsay.normalize import weibo
    cards = [3, None, "x", {"card_type": "9", "mblog": {"id": 1, "user": "u", "isLongText": 0}},
             {"card_type": 9, "mblog": {"mid": "2", "user": {"id": 7}, "isLongText": True,
                                        "reposts_count": 2.9, "comments_count": " 12 ",
                                        "attitudes_count": "-3"}},
             {"card_type": 9, "mblog": 5, "card_group": {"card_type": 9}},
             {"card_type": None, "mblog": {"id": 3}, "card_group": [
                 None, 4, {"card_type": 9.0, "mblog": {"id": {"a": 1}}}]}]
    bodies = [json.dumps(b) for b in ({"data": {"cards": cards}}, {"data": {"cards": {}}}, [1])]
    p = spark.createDataFrame([("k", i, b) for i, b in enumerate([*bodies, "no", None])],
                              "keyword string, page_no int, body string")
    found = weibo.norm_cards(p)
    assert rows(found, "card", "member") == [(3, 0), (4, 0), (5, 0), (6, 3)]
    assert rows(weibo.norm_micropost(found, 0), "id", "user_id", "reposts_count",
                "comments_count", "attitudes_count", "is_long") == [
        ("1", "", 0, 0, 0, False), ("2", "7", 2, 12, 0, True), ('{"a":1}', "", 0, 0, 0, False)]


def test_short_and_long_texts_are_stripped_alike(spark):
    cases = {"<a>　x </a>\x1cy\xa0": "x y", "<b>a<i b": "a<i b", "a <1> <b> </b>c": "a <1> c",
             "<SCRIPT>x</script>y<!-- z": "y<!-- z", "<b></b> <i> </i>": "", "<p>a\x01b": "a b"}
    df = spark.createDataFrame([(t + tail,) for t in cases for tail in ("", "<b> </b>" * 200)],
                               "t string")
    got = [r[0] for r in df.select(X.strip_html(F.col("t"), " ", strip=True)).collect()]
    assert got[::2] == list(cases.values())
    short = {t: w for t, w in cases.items() if ">" in t and "!" not in t and "<i b" not in t}
    assert [g for t, g in zip(cases, got[1::2]) if t in short] == list(short.values())
