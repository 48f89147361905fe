"""Text cleaning, tokens, sentiment, hot words, lexicon, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import analytics
from catalog.analytics import DAY
from catalog.fixtures import (
    CLAUSES, LETTER, LEXICON, STOPWORDS, TOKEN_REGEX, Fixtures, duck,
)
from catalog.registry import query
from hearsay.functions import scalars as S, text as X, times as T
from hearsay.operators import hotwords as H, lexicon as L, sentiment as N

LANG = "en"
TOKENS = X.regex_tokenizer(TOKEN_REGEX)


# ---- DuckDB building blocks -------------------------------------------------------------

def visible(col: str) -> str:
    """Text nodes of HTML separated by chr(1)."""
    hidden = "(?is)<!--.*?-->" + "".join(
        rf"|<{t}\b[^>]*>.*?(</{t}\s*>|\z)" for t in ("script", "style", "template"))
    return (f"regexp_replace(regexp_replace(regexp_replace({col}, '{hidden}', chr(1), 'g'), "
            f"'(?s)(<[a-zA-Z/!?][^>]*>)+', chr(1), 'g'), chr(1) || '+', chr(1), 'g')")


def decoded(text: str) -> str:
    for name, char in X.ENTITIES:
        quoted = char.replace("'", "''")
        text = f"replace({text}, '{name}', '{quoted}')"
    return f"replace({text}, '&amp;', '&')"


def stripped(col: str) -> str:
    plain = decoded(f"replace(trim({visible(col)}, chr(1)), chr(1), ' ')")
    return f"CASE WHEN contains({col}, '<') THEN {plain} ELSE COALESCE({col}, '') END"


def cleaned(col: str) -> str:
    return rf"trim(regexp_replace({stripped(col)}, '[\s\x{{00a0}}]+', ' ', 'g'))"


LEX = "SELECT term, " + ", ".join(
    f"max(value) FILTER (bucket = '{b}') AS {name}"
    for b, name in (("positive", "pos"), ("negative", "neg"), ("degree", "degree"))
) + ", COALESCE(bool_or(bucket = 'negation'), false) AS negates FROM (VALUES " + ", ".join(
    f"('{b}', '{t}', {v}::DOUBLE)" for b, t, v in LEXICON
) + ") l(bucket, term, value) GROUP BY term"


def scores(units: str, key: str) -> dict[str, str]:
    """Scores of ``units``(key, text) by a look-back over all tokens of each clause."""
    lags = ", ".join(
        f"lag(degree, {i}) OVER w AS d{i}, COALESCE(lag(negates, {i}) OVER w, false) AS n{i}, "
        f"COALESCE(lag(pos IS NOT NULL OR neg IS NOT NULL, {i}) OVER w, false) AS s{i}"
        for i in (1, 2, 3))
    stop = {i: f"(d{i} IS NULL AND NOT n{i} AND s{i})" for i in (1, 2)}
    live = {1: "true", 2: f"NOT {stop[1]}", 3: f"NOT {stop[1]} AND NOT {stop[2]}"}
    mult = " * ".join(f"CASE WHEN {live[i]} THEN COALESCE(d{i}, 1.0) ELSE 1.0 END" for i in live)
    negs = " + ".join(
        f"CASE WHEN {live[i]} AND d{i} IS NULL AND n{i} THEN 1 ELSE 0 END" for i in live)
    return {
        "lex": LEX,
        "clause_lists": f"SELECT {key}, regexp_split_to_array(text, '{CLAUSES}') AS cs "
                        f"FROM {units}",
        "clauses": f"SELECT {key}, generate_subscripts(cs, 1) AS cno, unnest(cs) AS clause "
                   f"FROM clause_lists",
        "token_lists": f"SELECT {key}, cno, regexp_extract_all(lower(clause), '{TOKEN_REGEX}') "
                       f"AS ts FROM clauses",
        "toks": f"SELECT {key}, cno, generate_subscripts(ts, 1) AS tno, unnest(ts) AS term "
                f"FROM token_lists",
        "looked": f"SELECT {key}, lex.*, {lags} FROM toks LEFT JOIN lex USING (term) "
                  f"WINDOW w AS (PARTITION BY {key}, cno ORDER BY tno)",
        "anchors": f"SELECT {key}, CASE WHEN pos IS NOT NULL THEN 1 ELSE -1 END "
                   f"* CASE WHEN ({negs}) % 2 = 1 THEN -1 ELSE 1 END AS sgn, "
                   f"COALESCE(pos, neg) * {mult} "
                   f"* CASE WHEN ({negs}) % 2 = 1 THEN 0.7 ELSE 1.0 END AS size "
                   f"FROM looked WHERE pos IS NOT NULL OR neg IS NOT NULL",
        "scored": f"SELECT {key}, COALESCE(sum(sgn * size), 0.0) AS raw, "
                  f"tanh(COALESCE(sum(sgn * size), 0.0) / 4.0) AS score, "
                  f"count(*) FILTER (sgn > 0) AS pos_hits, "
                  f"count(*) FILTER (sgn < 0) AS neg_hits "
                  f"FROM {units} LEFT JOIN anchors USING ({key}) GROUP BY ALL",
        "labelled": "SELECT *, CASE WHEN score > 0.1 THEN 'pos' WHEN score < -0.1 THEN 'neg' "
                    "ELSE 'neu' END AS label FROM scored",
    }


def _text_sql(part: str) -> str:
    for name in ("links", "videos", "answers", "comments"):
        part = part.replace(f"fx_{name}", f"fx_text_{name}")
    return part.replace("fx_posts", "fx_texts")


def row_text_sql(*cols: str) -> str:
    cells = ", ".join(
        f"CASE WHEN trim({c}) <> '' AND lower(trim({c})) <> 'nan' "
        f"THEN trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END"
        for c in cols)
    return f"concat_ws(' ', {cells})"


UNITS = {
    "pairs": analytics.PAIRS,
    "linked": _text_sql(analytics.LINKED),
    "answer_ids": _text_sql(analytics.ANSWER_IDS),
    "comment_keys": _text_sql(analytics.COMMENT_KEYS),
    "all_units": f"""
SELECT keyword, 'post' AS source, platform, post_id, post_id AS unit_id, published_at,
  {cleaned(row_text_sql('title', 'content'))} AS text FROM linked
UNION ALL
SELECT k.keyword, 'answer', p.platform, p.post_id, p.post_id, p.published_at,
  {cleaned(row_text_sql('p.content'))}
FROM fx_texts p JOIN (SELECT DISTINCT keyword, post_id FROM answer_ids) k USING (post_id)
WHERE p.platform = 'zhihu_answer'
UNION ALL
SELECT k.keyword, 'comment', c.platform, c.post_id, c.comment_id, c.published_at,
  {cleaned(row_text_sql('c.content'))}
FROM fx_text_comments c
JOIN (SELECT DISTINCT keyword, platform, post_id FROM comment_keys) k USING (platform, post_id)
""",
    "units": "SELECT row_number() OVER () AS u, * FROM all_units WHERE text <> ''",
}


def unit_sql(select: str, where: str = f"keyword = '{LANG}'") -> str:
    parts = dict(UNITS)
    parts["units"] += f" AND {where}" if where else ""
    parts |= scores("units", "u")
    parts["rows"] = ("SELECT units.*, score, label, pos_hits, neg_hits FROM units "
                     "JOIN labelled USING (u)")
    return duck(select, **parts)


def scored(f: Fixtures, sources=N.SOURCES):
    return N.scored_units(f.texts, LANG, f.lexicon, sources, TOKENS, CLAUSES)


# ---- cleaning and tokens ----------------------------------------------------------------

query("strip_html", f"SELECT page_id, {stripped('html')} AS text FROM pages")(
    lambda f: f.pages.select("page_id", X.strip_html(F.col("html")).alias("text")))
query("strip_html_lines", f"""
SELECT page_id, {decoded("array_to_string(list_filter(list_transform(string_split(" + visible('html')
    + r", chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))")}
  AS text FROM pages""")(
    lambda f: f.pages.select("page_id", X.strip_html(F.col("html"), "\n", True).alias("text")))
query("clean_text", f"SELECT page_id, {cleaned('html')} AS text FROM pages")(
    lambda f: f.pages.select("page_id", X.clean_text(F.col("html")).alias("text")))
query("clause_split", f"""
SELECT doc_id, clause, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_split_to_array(text, '{CLAUSES}')) AS clause FROM documents)
WHERE clause <> '' GROUP BY 1, 2""")(
    lambda f: f.documents.select(
        "doc_id", F.explode(X.clauses(F.col("text"), CLAUSES)).alias("clause")
    ).groupBy("doc_id", "clause").agg(F.count(F.lit(1)).alias("n")))
query("tokenize_counts", f"""
SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(text), '{TOKEN_REGEX}')) AS word FROM documents)
WHERE length(word) >= 2 AND word NOT IN ({', '.join(repr(w) for w in STOPWORDS)})
GROUP BY 1""")(
    lambda f: H.token_counts(f.documents, "text", TOKENS, f.words(STOPWORDS), LETTER))
# The dictionary: the short words of the documents themselves, with their frequencies. Texts are cut
# into them as if they had no spaces; no dictionary word holds one.
LONGEST = 4
SEGMENTED = rf"""
WITH RECURSIVE met AS (
  SELECT w, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM documents) GROUP BY 1),
short AS (SELECT w, n FROM met WHERE length(w) <= {LONGEST}),
dict AS (SELECT w, CAST(round(ln((SELECT sum(n) FROM short) / n) * 1000000) AS BIGINT) AS cost
  FROM short),
places AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM met),
edges AS (
  SELECT p.w, i, len, COALESCE(cost, CASE len WHEN 1 THEN CAST(round(ln((SELECT sum(n) FROM short))
    * 1000000) AS BIGINT) END) AS cost, cost IS NOT NULL AS known
  FROM places p, (SELECT unnest(range(1, {LONGEST + 1})) AS len) l
  LEFT JOIN dict d ON d.w = substring(p.w, i, len)
  WHERE i + len <= length(p.w) + 1 AND (cost IS NOT NULL OR len = 1)),
options AS (SELECT w, i, list([cost, len]) AS o, max(len) FILTER (known OR len = 1) AS most
  FROM edges GROUP BY w, i),
"""
BEST_PATH = SEGMENTED + """
dp AS (
  SELECT w, length(w) + 1 AS i, [0::BIGINT] AS best, []::BIGINT[] AS lens FROM met
  UNION ALL
  SELECT w, i, list_prepend(pick[1], best), list_prepend(-pick[2], lens) FROM (
    SELECT dp.w, e.i, best, lens,
      list_sort(list_transform(o, lambda x: [x[1] + best[x[2]], -x[2]]))[1] AS pick
    FROM dp JOIN options e ON e.w = dp.w AND e.i = dp.i - 1)),
walk AS (
  SELECT w, lens, 1::BIGINT AS p FROM dp WHERE i = 1
  UNION ALL
  SELECT w, lens, p + lens[p] FROM walk WHERE p + lens[p] <= length(w))
SELECT substring(w, p, lens[p]) AS word, CAST(sum(n) AS BIGINT) AS n FROM walk JOIN met USING (w)
WHERE lens[p] >= 2 GROUP BY 1"""
MAX_MATCH = SEGMENTED + """
walk AS (
  SELECT w, 1::BIGINT AS p FROM met
  UNION ALL
  SELECT walk.w, p + most FROM walk JOIN options o ON o.w = walk.w AND o.i = p
  WHERE p + most <= length(walk.w))
SELECT substring(w, p, most) AS word, CAST(sum(n) AS BIGINT) AS n
FROM walk JOIN options o USING (w) JOIN met USING (w) WHERE o.i = p AND most >= 2 GROUP BY 1"""


def _short_words(f: Fixtures):
    words = X.regex_tokenizer(LETTER + "+")(F.col("text"))
    return f.documents.select(F.explode(words).alias("word")).where(
        F.char_length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _segmented(f: Fixtures, tokenizer: X.Tokenizer):
    tokens = f.documents.select(F.explode(tokenizer(F.lower("text"))).alias("word"))
    return tokens.where(X.is_word(F.col("word"), LETTER)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))


query("tokenize_best_path", BEST_PATH)(lambda f: _segmented(
    f, X.best_path_tokenizer(f.spark, _short_words(f), whole_runs=False)))
query("tokenize_max_match", MAX_MATCH)(lambda f: _segmented(
    f, X.max_match_tokenizer(f.spark, [r.word for r in _short_words(f).collect()],
                             whole_runs=False)))
query("row_text_concat", f"""
SELECT doc_id, {row_text_sql('source', 'text', 'lang', 'nullif(source, lang)')} AS text
FROM documents""")(
    lambda f: f.documents.select("doc_id", S.row_text(
        F.col("source"), F.col("text"), F.col("lang"), F.nullif(F.col("source"), F.col("lang"))
    ).alias("text")))

# ---- sentiment --------------------------------------------------------------------------

query("sentiment_scores", duck("""
SELECT doc_id, round(raw, 6) AS raw, round(score, 6) AS score, label, pos_hits, neg_hits
FROM labelled""", docs=f"SELECT doc_id, {cleaned('text')} AS text FROM documents",
    **scores("docs", "doc_id")))(
    lambda f: N.score_texts(
        f.documents.select("doc_id", X.clean_text(F.col("text")).alias("text")),
        ["doc_id"], "text", f.lexicon, TOKENS, CLAUSES,
    ).select("doc_id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"),
             "label", "pos_hits", "neg_hits"))
query("sentiment_for_keyword", unit_sql("""
SELECT platform, source, post_id, unit_id, published_at, substring(text, 1, 120) AS text,
  round(score, 6) AS score, label, pos_hits, neg_hits FROM rows"""))(
    lambda f: N.sentiment_for_keyword(scored(f)).withColumn("score", F.round("score", 6)))
SUMMARY = """count(*) AS n, count(*) FILTER (label = 'pos') AS pos,
  count(*) FILTER (label = 'neu') AS neu, count(*) FILTER (label = 'neg') AS neg,
  round(count(*) FILTER (label = 'pos') / count(*), 3) AS pos_share,
  round(count(*) FILTER (label = 'neg') / count(*), 3) AS neg_share,
  round(avg(score), 3) AS mean_score,
  CASE WHEN avg(score) > 0.1 THEN 'pos' WHEN avg(score) < -0.1 THEN 'neg' ELSE 'neu' END
    AS tendency"""
query("sentiment_summary", unit_sql(f"SELECT {SUMMARY} FROM rows"))(
    lambda f: N.sentiment_summary(scored(f)))
query("sentiment_summary_comments", unit_sql(
    f"SELECT {SUMMARY} FROM rows", f"keyword = '{LANG}' AND source = 'comment'"))(
    lambda f: N.sentiment_summary(scored(f, ("comments",))))
query("sentiment_summary_all_keywords", unit_sql(
    f"SELECT keyword, {SUMMARY} FROM rows GROUP BY keyword", ""))(
    lambda f: N.sentiment_summary_all_keywords(f.texts, f.lexicon, TOKENS, CLAUSES))
query("sentiment_by_day", unit_sql(f"""
SELECT {DAY.format('published_at')} AS day, count(*) AS n, round(avg(score), 3) AS mean_score,
  count(*) FILTER (label = 'pos') AS pos, count(*) FILTER (label = 'neu') AS neu,
  count(*) FILTER (label = 'neg') AS neg
FROM rows WHERE published_at IS NOT NULL GROUP BY 1"""))(
    lambda f: N.sentiment_by_day(scored(f)))
query("sentiment_by_day_all_keywords", unit_sql(f"""
SELECT keyword, {DAY.format('published_at')} AS day, count(*) AS n,
  round(avg(score), 3) AS mean_score, count(*) FILTER (label = 'pos') AS pos,
  count(*) FILTER (label = 'neu') AS neu, count(*) FILTER (label = 'neg') AS neg
FROM rows WHERE published_at IS NOT NULL GROUP BY 1, 2""", ""))(
    lambda f: N.sentiment_by_day_all_keywords(f.texts, f.lexicon, TOKENS, CLAUSES))
query("sentiment_breakdown", unit_sql("""
SELECT label, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM rows), 1) AS percent
FROM rows GROUP BY 1"""))(lambda f: N.sentiment_breakdown(scored(f)))
query("sentiment_weighted", unit_sql("""
SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS weight,
  round(sum(score * length(text)) / sum(length(text)), 6) AS mean_score FROM rows"""))(
    lambda f: N.sentiment_weighted(scored(f)))

# ---- hot words and lexicon --------------------------------------------------------------

HOT = {
    **UNITS,
    "units": f"SELECT row_number() OVER () AS u, * FROM all_units "
             f"WHERE text <> '' AND keyword = '{LANG}'",
    "occ": f"SELECT u, unnest(regexp_extract_all(lower(text), '{TOKEN_REGEX}')) AS word "
           "FROM units",
    "freq": "SELECT word, count(*) AS n, count(DISTINCT u) AS df FROM occ "
            "WHERE length(word) >= 2 GROUP BY 1",
    "weighed": """
SELECT word, round(n * ln((nt + 1) / (df + 1)) / total, 9) AS weight
FROM freq, (SELECT CAST(sum(n) AS BIGINT) AS total FROM freq),
  (SELECT count(*) AS nt FROM units)""",
}


def hot(f: Fixtures, **kw):
    units = N.text_units(f.texts, F.col("keyword") == LANG)
    counts = H.word_counts(units, "text", TOKENS, weight="n_links")
    return H.top_keywords(counts, 30, TOKENS, must_contain=LETTER, **kw)


query("top_keywords", duck(
    "SELECT word, weight FROM weighed ORDER BY weight DESC, word LIMIT 30", **HOT))(hot)
query("top_keywords_exclude", duck(
    f"SELECT word, weight FROM weighed WHERE word NOT IN "
    f"({', '.join(repr(w) for w in STOPWORDS + ['and the with', 'and', 'the', 'with'])}) "
    f"ORDER BY weight DESC, word LIMIT 30", **HOT))(
    lambda f: hot(f, stopwords=f.words(STOPWORDS), exclude=["and the with"]))
query("top_keywords_idf_table", duck(
    "SELECT word, weight FROM w2 ORDER BY weight DESC, word LIMIT 30", **{
        **HOT, "occ_docs": f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text),"
                           f" '{TOKEN_REGEX}'))) AS word FROM documents",
        "idf": "SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf "
               "FROM occ_docs GROUP BY 1",
        # Every unit with prose comes from documents or conversations; words of the latter
        # that documents lack take the median.
        "med": "SELECT quantile_disc(idf, 0.5) AS med FROM idf",
        "w2": "SELECT word, round(n * COALESCE(idf, med) / total, 9) AS weight FROM freq "
              "LEFT JOIN idf USING (word), med, "
              "(SELECT CAST(sum(n) AS BIGINT) AS total FROM freq)"}))(
    lambda f: hot(f, idf=H.corpus_idf(f.documents, ["doc_id"], "text", TOKENS)))

RAW_SQL = """
SELECT category, term, CASE WHEN n % 7 = 0 THEN 'n/a' ELSE concat(
  CAST(CAST(floor(n / 100) AS BIGINT) AS VARCHAR), '.', lpad(CAST(n % 100 AS VARCHAR), 2, '0'))
  END AS value
FROM (SELECT category, term, count(*) AS n FROM (
  SELECT term, CASE WHEN toxic = 1 THEN 'neg-general' WHEN quality = 1 THEN 'pos-general'
    WHEN quality = 0 THEN 'pos-domain' WHEN length(term) = 3 THEN 'degree'
    WHEN length(term) = 2 THEN 'negation' ELSE 'stopwords' END AS category
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}0-9]+')) AS term
        FROM documents) LEFT JOIN labels USING (doc_id)) GROUP BY 1, 2)"""
BUILT = {
    "raw_lex": RAW_SQL,
    "cat": "SELECT * FROM (VALUES ('pos-general', 'positive', 1.0, 2.0, 2), "
           "('pos-domain', 'positive', 1.0, 2.0, 2), ('neg-general', 'negative', 1.0, 2.0, 2), "
           "('degree', 'degree', 0.3, 2.5, 1), ('negation', 'negation', NULL, NULL, 1), "
           "('stopwords', 'stopword', NULL, NULL, 1)) c(category, bucket, lo, hi, len)",
    "valid": r"""
SELECT bucket, term, max(CASE WHEN lo IS NULL THEN 1.0 ELSE
    round(greatest(lo, least(hi, TRY_CAST(value AS DOUBLE))), 2) END) AS value
FROM raw_lex JOIN cat USING (category)
WHERE regexp_matches(term, '^\p{L}+$') AND length(term) >= len
  AND (lo IS NULL OR TRY_CAST(value AS DOUBLE) IS NOT NULL) GROUP BY 1, 2""",
    "polar": "SELECT * FROM valid WHERE bucket IN ('positive', 'negative') AND term NOT IN "
             "(SELECT term FROM valid WHERE bucket = 'positive' INTERSECT "
             "SELECT term FROM valid WHERE bucket = 'negative')",
    "built": "SELECT * FROM polar UNION ALL SELECT * FROM valid WHERE bucket = 'degree' AND "
             "term NOT IN (SELECT term FROM polar) AND term NOT IN "
             "(SELECT term FROM valid WHERE bucket = 'negation') UNION ALL "
             "SELECT * FROM valid WHERE bucket = 'negation' UNION "
             "(SELECT 'stopword', unnest([" + ", ".join(f"'{w}'" for w in STOPWORDS)
             + "]), 1.0 UNION SELECT * FROM valid WHERE bucket = 'stopword')",
}


def raw_lexicon(f: Fixtures):
    """Raw lexicon rows derived from labelled documents."""
    words = f.documents.select("doc_id", F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(r"([\p{L}0-9]+)"), 1)).alias("term"))
    category = (
        F.when(F.col("toxic") == 1, "neg-general").when(F.col("quality") == 1, "pos-general")
        .when(F.col("quality") == 0, "pos-domain").when(F.char_length("term") == 3, "degree")
        .when(F.char_length("term") == 2, "negation").otherwise("stopwords"))
    n = F.col("n")
    value = F.concat(F.floor(n / 100).cast("string"), F.lit("."),
                     F.lpad((n % 100).cast("string"), 2, "0"))
    return (
        words.join(f.labels, "doc_id", "left").groupBy(category.alias("category"), "term")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("category", "term", F.when(n % 7 == 0, "n/a").otherwise(value).alias("value"))
    )


query("lexicon_build", duck(
    "SELECT bucket, term, CAST(value AS DOUBLE) AS value FROM built", **BUILT))(
    lambda f: L.lexicon_build(raw_lexicon(f), r"^\p{L}+$", f.words(STOPWORDS)))
query("lexicon_stats", duck(
    "SELECT bucket, count(*) AS n_terms FROM built GROUP BY 1", **BUILT))(
    lambda f: L.lexicon_stats(L.lexicon_build(raw_lexicon(f), r"^\p{L}+$", f.words(STOPWORDS))))
query("sentiment_scores_built_lexicon", duck("""
SELECT doc_id, round(score, 6) AS score, label, pos_hits, neg_hits FROM labelled""",
    docs=f"SELECT doc_id, {cleaned('text')} AS text FROM documents", **BUILT, **{
        **scores("docs", "doc_id"), "lex": LEX[:LEX.index("FROM (VALUES")]
        + "FROM built WHERE bucket <> 'stopword' GROUP BY term"}))(
    lambda f: N.score_texts(
        f.documents.select("doc_id", X.clean_text(F.col("text")).alias("text")), ["doc_id"],
        "text", L.lexicon_build(raw_lexicon(f), r"^\p{L}+$", f.words(STOPWORDS)), TOKENS, CLAUSES,
        large_lexicon=True,
    ).select("doc_id", F.round("score", 6).alias("score"), "label", "pos_hits", "neg_hits"))

# ---- scalar functions -------------------------------------------------------------------

INT = "CASE WHEN regexp_matches({0}, '^ *[0-9]+ *$') THEN CAST(trim({0}) AS BIGINT) ELSE 0 END"
query("lenient_int", f"""
SELECT p_partkey, {INT.format('CAST(p_size AS VARCHAR)')} AS from_int,
  {INT.format("concat('  ', CAST(p_partkey AS VARCHAR), ' ')")} AS from_padded,
  {INT.format('CAST(p_retailprice AS VARCHAR)')} AS from_decimal,
  {INT.format('p_brand')} AS from_word, 0::BIGINT AS from_null FROM part""")(
    lambda f: f.part.select(
        "p_partkey", S.lenient_int(F.col("p_size").cast("string")).alias("from_int"),
        S.lenient_int(F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit(" ")))
        .alias("from_padded"),
        S.lenient_int(F.col("p_retailprice").cast("string")).alias("from_decimal"),
        S.lenient_int(F.col("p_brand")).alias("from_word"),
        S.lenient_int(F.lit(None).cast("string")).alias("from_null")))

AS_OF = 1718000000
_TS = "CAST(ts AS VARCHAR)"  # both engines print yyyy-MM-dd HH:mm:ss[.f]
_TIMES = {
    0: ("'刚刚'", str(AS_OF)),
    1: ("concat(CAST(user_id AS VARCHAR), '分钟前')", f"{AS_OF} - user_id * 60"),
    2: ("concat(CAST(user_id AS VARCHAR), ' 小时前')", f"{AS_OF} - user_id * 3600"),
    3: (f"concat('昨天 ', substring({_TS}, 12, 5))",
        f"{AS_OF} - {AS_OF} % 86400 - 86400 + (e - e % 60) % 86400"),
    4: (f"substring({_TS}, 1, 19)", "e"),
    5: (f"substring({_TS}, 1, 10)", "e - e % 86400"),
    6: (f"substring({_TS}, 6, 11)", "e - e % 60"),
    7: (f"concat('Mon Jan ', substring({_TS}, 9, 2), ' ', substring({_TS}, 12, 8), "
        f"' +0800 2024')", "e - 28800"),
    8: ("event_type", "NULL"),
}


def _case(i: int) -> str:
    return "CASE event_id % 9 " + " ".join(
        f"WHEN {k} THEN {v[i]}" for k, v in _TIMES.items()) + " END"


query("parse_time_formats", f"""
SELECT event_id, {_case(0)} AS text, CAST({_case(1)} AS BIGINT) AS epoch
FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS e FROM events)""")(
    lambda f: f.events.selectExpr("event_id", f"{_case(0).replace('VARCHAR', 'STRING')} AS text")
    .withColumn("epoch", T.parse_post_time(F.col("text"), F.lit(AS_OF))))

PAGE_PATTERNS = [
    (r"example\.com/([a-z]{2})/(\d+)", "com_page"),
    (r"example\.(?:net|org)/[a-z]{2}/(\d+)", "other_page"),
    (r"(example)", "site"),
]
query("classify_urls", r"""
SELECT page_id, CASE WHEN com THEN 'com_page' WHEN oth THEN 'other_page'
    WHEN contains(url, 'example') THEN 'site' END AS kind,
  CASE WHEN com THEN regexp_extract(url, 'example\.com/([a-z]{2})/(\d+)', 1)
    WHEN oth THEN regexp_extract(url, 'example\.(?:net|org)/[a-z]{2}/(\d+)', 1)
    WHEN contains(url, 'example') THEN 'example' END AS id,
  CASE WHEN com THEN regexp_extract(url, 'example\.com/([a-z]{2})/(\d+)', 2) END AS id2
FROM (SELECT *, regexp_matches(url, 'example\.com/[a-z]{2}/\d+') AS com,
  regexp_matches(url, 'example\.(net|org)/[a-z]{2}/\d+') AS oth FROM pages)""")(
    lambda f: f.pages.select(
        "page_id", S.classify_url(F.col("url"), PAGE_PATTERNS).alias("c")
    ).select("page_id", "c.*"))
query("classify_post_urls", duck("""
SELECT platform, post_id, CASE platform WHEN 'weibo' THEN 'weibo_post' WHEN 'tieba'
  THEN 'tieba_thread' ELSE platform END AS kind,
  CASE platform WHEN 'zhihu_answer' THEN CAST(CAST(post_id AS BIGINT) - 1 AS VARCHAR)
    WHEN 'bili' THEN NULL ELSE post_id END AS id,
  CASE platform WHEN 'zhihu_answer' THEN post_id END AS id2
FROM fx_posts""").replace("ELSE platform END AS kind",
                          "WHEN 'bili' THEN NULL ELSE platform END AS kind"))(
    lambda f: f.fx_posts.select(
        "platform", "post_id", S.classify_url(F.col("url")).alias("c")
    ).select("platform", "post_id", "c.*"))
query("classify_ids", """
SELECT c_custkey, 'bili_video' AS from_bv, 'zhihu_question' AS from_digits,
  CAST(NULL AS VARCHAR) AS from_name FROM customer""")(
    lambda f: f.customer.select(
        "c_custkey",
        S.classify_id(F.concat(F.lit(" bv"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")))
        .alias("from_bv"),
        S.classify_id(F.col("c_custkey").cast("string")).alias("from_digits"),
        S.classify_id(F.col("c_name")).alias("from_name")))
query("sanitize_keyword", r"""
SELECT doc_id, COALESCE(nullif(substring(regexp_replace(text, '[^\p{L}\p{N}_.\-]', '', 'g'),
  1, 80), ''), 'keyword') AS name FROM documents""")(
    lambda f: f.documents.select("doc_id", S.sanitize_keyword(F.col("text")).alias("name")))
query("label_shares", """
SELECT quality, toxic, n, printf('%.1f%%', round(n / (SELECT count(*) FROM labels), 3) * 100)
  AS share FROM (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2)""")(
    lambda f: f.labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "share", S.percent(F.round(
            F.col("n") / f.labels.agg(F.count(F.lit(1))).scalar(), 3))))
