import math

import pytest
from pyspark.sql import functions as F

from hearsay.functions.text import CLAUSE_REGEX, max_match_tokenizer, regex_tokenizer
from hearsay.operators import hotwords, lexicon, sentiment as N

LEX = [("positive", "喜欢", 1.5), ("positive", "精彩", 1.0), ("negative", "糟糕", 1.2),
       ("negative", "讨厌", 1.4), ("degree", "非常", 1.8), ("degree", "有点", 0.6),
       ("negation", "不", 1.0), ("negation", "没有", 1.0)]


def score(spark, texts):
    lex = spark.createDataFrame(LEX, "bucket string, term string, value double")
    words = lexicon.dictionary_words(lex) + ["没有"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = N.score_texts(df, ["i"], "text", lex, max_match_tokenizer(spark, words), CLAUSE_REGEX)
    return {r.i: r for r in out.collect()}


@pytest.mark.parametrize("text, raw, pos, neg", [
    ("我喜欢", 1.5, 1, 0),
    ("我非常喜欢", 1.5 * 1.8, 1, 0),
    ("我不喜欢", -1.5 * 0.7, 0, 1),
    ("我不是不喜欢", 1.5, 1, 0),  # two negations cancel
    ("不糟糕", 1.2 * 0.7, 1, 0),
    ("不好，很喜欢", 1.5, 1, 0),  # negation stays in its clause
    ("不讨厌喜欢", 1.4 * 0.7 + 1.5, 2, 0),  # a sentiment word ends the look-back
    ("不一二三喜欢", 1.5, 1, 0),  # four tokens away
    ("不一二喜欢", -1.5 * 0.7, 0, 1),  # three tokens away
    ("有点非常喜欢", 1.5 * 0.6 * 1.8, 1, 0),
    ("天气", 0.0, 0, 0),
    ("", 0.0, 0, 0),
])
def test_golden(spark, text, raw, pos, neg):
    r = score(spark, [text])[0]
    assert r.raw == pytest.approx(raw)
    assert r.score == pytest.approx(math.tanh(raw / 4))
    assert (r.pos_hits, r.neg_hits) == (pos, neg)
    assert r.label == ("pos" if r.score > 0.1 else "neg" if r.score < -0.1 else "neu")


def test_whole_documents_equal_a_direct_loop(spark):
    """Brute force over whole texts, token by token."""
    import re

    from catalog.fixtures import CLAUSES, LEXICON
    lex = spark.createDataFrame(LEXICON, "bucket string, term string, value double")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in N.score_texts(
        docs, ["doc_id"], "text", lex, regex_tokenizer(), CLAUSES).collect()}
    table = {b: {t: v for k, t, v in LEXICON if k == b}
             for b in ("positive", "negative", "degree", "negation")}
    for row in docs.collect():
        total = pos = neg = 0
        for clause in re.split(CLAUSES, row.text):
            words = re.findall(r"[^\W\d_]+", clause.lower())
            for i, w in enumerate(words):
                size = table["positive"].get(w, table["negative"].get(w))
                if size is None:
                    continue
                sign = 1 if w in table["positive"] else -1
                flips = 0
                for p in reversed(words[max(0, i - 3):i]):
                    if p in table["degree"]:
                        size *= table["degree"][p]
                    elif p in table["negation"]:
                        flips += 1
                    elif p in table["positive"] or p in table["negative"]:
                        break
                if flips % 2:
                    sign, size = -sign, size * 0.7
                total += sign * size
                pos, neg = pos + (sign > 0), neg + (sign < 0)
        r = got[row.doc_id]
        assert r.raw == pytest.approx(total)
        assert (r.pos_hits, r.neg_hits) == (pos, neg)
    assert len(got) == docs.count()
    assert all(-1 <= r.score <= 1 for r in got.values())


def test_lexicon_build(spark, rows):
    raw = spark.createDataFrame([
        ("pos-general", "精彩", "1.234"), ("pos-domain", "精彩", "9"), ("pos-general", "好", "1"),
        ("pos-general", "yyds", "2"), ("pos-general", "破防", "1"), ("neg-general", "破防", "1"),
        ("neg-general", "糟糕", "x"), ("neg-domain", "难看", "0.1"), ("degree", "太", "5"),
        ("degree", "精彩", "2"), ("degree", "不太", "0.4"), ("negation", "不太", "1"),
        ("stopwords", "然后", "1"),
    ], "category string, term string, value string")
    built = lexicon.lexicon_build(raw).where(
        (F.col("bucket") != "stopword") | (F.col("term") == "然后"))
    assert rows(built) == [
        ("degree", "太", 2.5), ("negation", "不太", 1.0), ("negative", "难看", 1.0),
        ("positive", "精彩", 2.0), ("stopword", "然后", 1.0)]
    core = spark.createDataFrame([("的",), ("然后",)], "word string")
    stats = dict(rows(lexicon.lexicon_stats(lexicon.lexicon_build(raw, stopwords=core))))
    assert stats["stopword"] == 2


def test_read_raw_lexicon(spark, rows, tmp_path):
    (tmp_path / "l.json").write_text(
        '{"result": {"degree": [{"term": "太", "value": 1.7}], "negation": [{"term": "不"}]}}')
    assert rows(lexicon.read_raw_lexicon(spark, str(tmp_path / "l.json"))) == [
        ("degree", "太", "1.7"), ("negation", "不", "1.0")]


def test_hot_words_filter_and_exclude(spark):
    texts = ["电动车 电池 电池 but 2024", "电动车 续航 的 电池", "天气 很好", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tok = regex_tokenizer(r"[^\s]+")
    stop = spark.createDataFrame([("很好",)], "word string")
    counts = hotwords.word_counts(df, "text", tok)
    by_word = {r.word: (r.n, r.df) for r in counts.collect()}
    assert by_word["电池"] == (3, 2) and by_word[""] == (3, 3)
    top = hotwords.top_keywords(counts, 5, tok, stopwords=stop, exclude=["电动车"]).collect()
    assert [r.word for r in top] == ["电池", "天气", "续航"]
    total = 3 + 2 + 1 + 1 + 1 + 1 + 1
    assert top[0].weight == pytest.approx(3 / total * math.log(4 / 3), abs=1e-9)
    counts.unpersist()
