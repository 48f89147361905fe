"""Lexicon sentiment with degree words, negation and clause limits."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearsay.functions.scalars import row_text, utc_day
from hearsay.functions.text import (
    CLAUSE_REGEX, Tokenizer, clean_text, regex_tokenizer, tokens_with_boundaries,
)
from hearsay.operators.retrieve import (
    Corpus, answer_ids, comment_keys, comments_under, linked_posts, nested_answers,
)
from hearsay.operators.shared import SALTS, every_salt, repeat_rows
from hearsay.schema import unified_platforms

# Scoring constants.
WINDOW = 3  # tokens looked back for modifiers
NEGATION_DAMP = 0.7
SCALE = 4.0
NEUTRAL_BAND = 0.10
TEXT_PREVIEW = 120

SOURCES = ("posts", "answers", "comments")


def label_for(score: Column) -> Column:
    return F.when(score > NEUTRAL_BAND, "pos").when(score < -NEUTRAL_BAND, "neg").otherwise("neu")


def lexicon_by_term(lexicon: DataFrame) -> DataFrame:
    """One row per scoring term from rows (bucket, term, value)."""
    def of(bucket: str) -> Column:
        return F.max(F.when(F.col("bucket") == bucket, F.col("value")))

    return (
        lexicon.where(F.col("bucket").isin("positive", "negative", "degree", "negation"))
        .groupBy("term")
        .agg(
            of("positive").alias("pos"), of("negative").alias("neg"),
            of("degree").alias("degree"),
            F.max(F.col("bucket") == "negation").alias("negates"),
        )
    )


def _exploded(
    units: DataFrame, keys: Sequence[str], keep: Sequence[str], terms: Column
) -> DataFrame:
    """A row per element of ``terms``, whose first is the unit's head row (``pos`` -1). Only that
    one carries ``keep``. A frequent word is spread over the salts, should the lexicon join be
    a shuffle."""
    head = F.col("pos") == -1
    return (
        # Outer, for the filter Spark adds to the inner form would cut the texts once more.
        units.select(*keys, F.struct(F.lit(True).alias("_"), *keep).alias("_kept"),
                     terms.alias("_terms"))
        .select(*keys, "_kept", F.posexplode_outer("_terms"))
        .select(*keys, "_kept", (F.col("pos") - 1).alias("pos"), "col")
        .select(*keys, F.when(head, F.col("_kept")).alias("_kept"), "pos", "col",
                F.pmod("pos", F.lit(SALTS)).cast("bigint").alias("_salt"))
    )


def _hits_alone(
    units: DataFrame, keys: Sequence[str], keep: Sequence[str], tokens: Column, head_term: Column,
    terms: DataFrame,
) -> DataFrame:
    """Head rows and sentiment words of units whose key stands in one row, with what the lexicon
    says of the tokens before them. A token is exploded with those, so nothing is sorted."""
    def beside(ts: Column) -> Column:
        return F.arrays_zip(*[
            F.concat(*[F.array(F.lit(None).cast("string"))] * i, F.array(head_term), ts)
            for i in range(WINDOW + 1)
        ])

    zipped = F.transform(F.array(F.coalesce(tokens, F.array())), beside)[0]
    rows = _exploded(units, keys, keep, zipped).select(
        *keys, "_kept", "pos", "_salt", F.col("col.0").alias("term"),
        *[F.col(f"col.{i}").alias(f"_t{i}") for i in range(1, WINDOW + 1)],
    )
    hits = rows.join(terms.drop("look"), ["term", "_salt"], "left").where(
        (F.col("pos") == -1) | F.col("lex_pos").isNotNull() | F.col("lex_neg").isNotNull())
    looks = terms.select("term", "_salt", "look")
    for i in range(1, WINDOW + 1):
        look = looks.withColumnsRenamed({"term": f"_t{i}", "look": f"_l{i}"})
        hits = hits.join(look, [f"_t{i}", "_salt"], "left")
    return hits.select(*keys, "_kept", "lex_pos", "lex_neg",
                       *[f"_l{i}" for i in range(1, WINDOW + 1)])


def _hits_merged(
    units: DataFrame, keys: Sequence[str], keep: Sequence[str], tokens: Column, head_term: Column,
    terms: DataFrame,
) -> DataFrame:
    """The same for units whose key stands in several rows: their lexicon hits are shuffled by
    the key and sorted by position, and the look-back runs over the hits of all rows."""
    words = F.concat(F.array(head_term), F.coalesce(tokens, F.array()))
    head = F.col("pos") == -1
    hits = _exploded(units, keys, keep, words).withColumnRenamed("col", "term").join(
        terms, ["term", "_salt"], "left").where(head | F.col("look").isNotNull())
    hits = hits.repartition(*keys)
    order = Window.partitionBy(*keys).orderBy("pos")
    context = F.when(~head, F.struct(F.col("pos").alias("at"), "look"))
    hits = hits.withColumns(
        {f"_c{i}": F.lag(context, i).over(order) for i in range(1, WINDOW + 1)}
    )
    return hits.select(*keys, "_kept", "lex_pos", "lex_neg", *[
        F.when(F.col("pos") - F.col(f"_c{i}.at") <= WINDOW, F.col(f"_c{i}.look")).alias(f"_l{i}")
        for i in range(1, WINDOW + 1)
    ])


def score_texts(
    units: DataFrame, keys: Sequence[str], text: str, lexicon: DataFrame,
    tokenizer: Tokenizer | None = None, clause_regex: str = CLAUSE_REGEX,
    keep: Sequence[str] = (), large_lexicon: bool = False,
) -> DataFrame:
    """Score every unit: keys, kept columns, raw, score, label, pos_hits, neg_hits.

    ``keys`` should identify a unit, which one job over the keys alone finds out at once. Tokens
    are exploded with the tokens before them and joined to the lexicon, a modifier counts when it
    is within the window, and three boundary tokens between clauses keep the window inside a
    clause. So a unit is summed where it is read, and what is shuffled by the unit key is one
    row per unit (which carries ``keep``). Rows that share a key are one unit, whose hits are
    merged by position; theirs are shuffled and sorted. Spark broadcasts the lexicon while its
    measured size is below the broadcast threshold and joins by shuffle beyond it. For a
    ``large_lexicon``, where that is expected, a token moves once and without those before it,
    and all hits are shuffled and sorted; the rows are the same.
    """
    tokenizer = tokenizer or regex_tokenizer()
    keep = [k for k in keep if k not in keys]
    tokens = tokens_with_boundaries(F.col(text), tokenizer, clause_regex, WINDOW)
    # Head rows match no term. They are spread, should the lexicon join be a shuffle.
    unlike_a_word = F.concat(F.lit("\u0003"), F.pmod(F.xxhash64(*keys), F.lit(4096)))
    terms = lexicon_by_term(lexicon).select(
        "term", every_salt().alias("_salt"), F.col("pos").alias("lex_pos"),
        F.col("neg").alias("lex_neg"), F.struct(
            "degree", "negates",
            (F.col("pos").isNotNull() | F.col("neg").isNotNull()).alias("sentiment"),
        ).alias("look"),
    )
    parts = (keys, keep, tokens, unlike_a_word, terms)

    repeated = units.groupBy(*[F.col(k).alias(f"_again_{k}") for k in keys]).agg(
        F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1).drop("_rows")
    if large_lexicon:
        hits = _hits_merged(units, *parts)
    elif repeated.isEmpty():
        hits = _hits_alone(units, *parts)
    else:
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_again_{k}"))
        hits = _hits_alone(units.join(repeated, same, "left_anti"), *parts).unionByName(
            _hits_merged(units.join(repeated, same, "left_semi"), *parts))

    multiplier, negations, live = F.lit(1.0), F.lit(0), F.lit(True)
    for i in range(1, WINDOW + 1):
        degree, negates = F.col(f"_l{i}.degree"), F.col(f"_l{i}.negates")
        multiplier = multiplier * F.when(live & degree.isNotNull(), degree).otherwise(1.0)
        negations = negations + F.when(live & degree.isNull() & negates, 1).otherwise(0)
        stops = degree.isNull() & ~negates & F.col(f"_l{i}.sentiment")
        live = live & ~F.coalesce(stops, F.lit(False))

    sign = F.when(F.col("lex_pos").isNotNull(), 1).when(F.col("lex_neg").isNotNull(), -1)
    base = F.coalesce("lex_pos", "lex_neg")
    scored = hits.select(
        *keys, "_kept", sign.alias("_sign"), base.alias("_base"),
        multiplier.alias("_mult"), (negations % 2 == 1).alias("_flip"),
    ).select(
        *keys, "_kept",
        F.when(F.col("_flip"), -F.col("_sign")).otherwise(F.col("_sign")).alias("_sign"),
        (F.col("_base") * F.col("_mult")
         * F.when(F.col("_flip"), NEGATION_DAMP).otherwise(1.0)).alias("_size"),
    )
    out = scored.groupBy(*keys).agg(
        F.max_by("_kept", F.col("_kept").isNotNull()).alias("_kept"),
        F.coalesce(F.sum(F.col("_sign") * F.col("_size")), F.lit(0.0)).alias("raw"),
        F.count_if(F.col("_sign") > 0).alias("pos_hits"),
        F.count_if(F.col("_sign") < 0).alias("neg_hits"),
    )
    score = F.tanh(F.col("raw") / SCALE)
    return out.select(
        *keys, *[F.col(f"_kept.{k}").alias(k) for k in keep],
        "raw", score.alias("score"), label_for(score).alias("label"), "pos_hits", "neg_hits",
    )


def text_units(
    c: Corpus, where: Column, sources: Sequence[str] = SOURCES
) -> DataFrame:
    """Cleaned texts of posts, answers and comments with their multiplicity.

    Columns: source, platform, post_id, unit_id, published_at, text, n_links. Blank texts are
    still in: a filter on the cleaned text would be pushed below the joins and clean texts no
    keyword reaches. They are dropped by their length after scoring.
    """
    links = c.links.where(where)
    parts = []
    if "posts" in sources:
        parts.append(linked_posts(c, where).select(
            F.lit("post").alias("source"), "platform", "post_id",
            F.col("post_id").alias("unit_id"), "published_at",
            clean_text(row_text(F.col("title"), F.col("content"))).alias("text"), "n_links",
        ))
    one = F.lit(1).cast("bigint").alias("n_links")
    if "answers" in sources:
        parts.append(nested_answers(c, links).select(
            F.lit("answer").alias("source"), "platform", "post_id",
            F.col("post_id").alias("unit_id"), "published_at",
            clean_text(row_text(F.col("content"))).alias("text"), one,
        ))
    if "comments" in sources:
        parts.append(comments_under(c, links).select(
            F.lit("comment").alias("source"), "platform", "post_id",
            F.col("comment_id").alias("unit_id"), "published_at",
            clean_text(row_text(F.col("content"))).alias("text"), one,
        ))
    if not parts:
        raise ValueError(f"sources must name some of {SOURCES}")
    units = parts[0]
    for part in parts[1:]:
        units = units.unionByName(part)
    return units


UNIT_KEYS = ["source", "platform", "post_id", "unit_id"]


def scored_units(
    c: Corpus, keyword: str, lexicon: DataFrame, sources: Sequence[str] = SOURCES,
    tokenizer: Tokenizer | None = None, clause_regex: str = CLAUSE_REGEX,
) -> DataFrame:
    """Scores of a keyword's texts, one row per text with ``n_links``."""
    units = text_units(c, F.col("keyword") == keyword, sources)
    units = units.withColumn("preview", F.substring("text", 1, TEXT_PREVIEW))
    units = units.withColumn("length", F.char_length("text").cast("bigint"))
    return score_texts(
        units, UNIT_KEYS, "text", lexicon, tokenizer, clause_regex,
        keep=["published_at", "preview", "length", "n_links"],
    ).where(F.col("length") > 0)


def sentiment_for_keyword(scored: DataFrame) -> DataFrame:
    """One row per text unit (and link)."""
    rows = scored.select(
        "platform", "source", "post_id", "unit_id", "published_at",
        F.col("preview").alias("text"), "score", "label", "pos_hits", "neg_hits", "n_links",
    )
    return repeat_rows(rows, "n_links")


def _label_counts(weight: Column) -> list[Column]:
    return [
        F.coalesce(F.sum(F.when(F.col("label") == name, weight)), F.lit(0)).cast("bigint")
        .alias(name)
        for name in ("pos", "neu", "neg")
    ]


def sentiment_summary(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, shares, mean and tendency; no row for an empty input."""
    w = F.col("n_links")
    total = F.sum(w)
    counted = scored.groupBy(*keys).agg(
        total.cast("bigint").alias("n"), *_label_counts(w),
        (F.sum(F.col("score") * w) / total).alias("mean"),
    ).where(F.col("n") > 0)
    return counted.select(
        *keys, "n", "pos", "neu", "neg",
        F.round(F.col("pos") / F.col("n"), 3).alias("pos_share"),
        F.round(F.col("neg") / F.col("n"), 3).alias("neg_share"),
        F.round("mean", 3).alias("mean_score"),
        label_for(F.col("mean")).alias("tendency"),
    )


def sentiment_by_day(scored: DataFrame) -> DataFrame:
    """Unweighted mean score and label counts per publish day (UTC)."""
    w = F.col("n_links")
    return (
        scored.where(F.col("published_at").isNotNull())
        .groupBy(utc_day(F.col("published_at")).alias("day"))
        .agg(
            F.sum(w).cast("bigint").alias("n"),
            F.round(F.sum(F.col("score") * w) / F.sum(w), 3).alias("mean_score"),
            *_label_counts(w),
        )
        .orderBy("day")
    )


def sentiment_breakdown(scored: DataFrame) -> DataFrame:
    """Label counts and shares in the order pos, neu, neg; absent labels are left out."""
    counts = scored.groupBy("label").agg(F.sum("n_links").cast("bigint").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # at most three rows
    position = F.when(F.col("label") == "pos", 0).when(F.col("label") == "neu", 1).otherwise(2)
    return counts.select(
        "label", "n", F.round(F.col("n") * 100 / total, 1).alias("percent")
    ).orderBy(position)


def sentiment_weighted(scored: DataFrame, weight: str = "length") -> DataFrame:
    """Mean score weighted by a column of the scored units, such as the text length."""
    w = F.col(weight) * F.col("n_links")
    return scored.agg(
        F.sum("n_links").cast("bigint").alias("n"), F.sum(w).cast("bigint").alias("weight"),
        F.round(F.try_divide(F.sum(F.col("score") * w), F.sum(w)), 6).alias("mean_score"),
    )


def keyword_reach(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """(keyword, platform, post_id, times) of every post and answer a keyword reaches, and of
    every post whose comments it reaches."""
    one = F.lit(1).cast("bigint").alias("times")
    direct = c.links.groupBy("keyword", "platform", "post_id").agg(
        F.count(F.lit(1)).alias("times")
    ).withColumn("platform", F.explode(unified_platforms(F.col("platform"))))
    nested = answer_ids(c, c.links, ["keyword"]).select(
        "keyword", F.lit("zhihu_answer").alias("platform"), "post_id", one
    )
    under = comment_keys(c, c.links, ["keyword"]).select("keyword", "platform", "post_id", one)
    return direct.unionByName(nested), under


def _keyword_sums(
    c: Corpus, lexicon: DataFrame, tokenizer: Tokenizer | None, clause_regex: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """keyword, ``keys``, n, pos, neu, neg and total (sum of scores) in one job.

    Each text is scored once, however many keywords reach it, and the scores are summed per
    post (and ``keys``) before the keywords are joined, so a hot post or keyword is one row at
    that join.
    """
    def per_post(rows: DataFrame, unit: list[str], *texts: str) -> DataFrame:
        units = rows.select(
            *unit, "published_at", clean_text(row_text(*map(F.col, texts))).alias("text")
        ).withColumn("length", F.char_length("text")).withColumn(
            "day", utc_day(F.col("published_at")))
        scored = score_texts(units, unit, "text", lexicon, tokenizer, clause_regex,
                             ["length", "day"])
        one = F.lit(1).cast("bigint")
        return scored.where(F.col("length") > 0).groupBy("platform", "post_id", *keys).agg(
            F.count(F.lit(1)).alias("units"), F.sum("score").alias("score"),
            *_label_counts(one),
        )

    on = ["platform", "post_id"]
    posts = per_post(c.posts, on, "title", "content")
    comments = per_post(c.comments, [*on, "comment_id"], "content")
    reached, under = keyword_reach(c)
    both = reached.join(posts, on).unionByName(under.join(comments, on))
    times = F.col("times")
    return both.groupBy("keyword", *keys).agg(
        F.sum(F.col("units") * times).cast("bigint").alias("n"),
        *[F.sum(F.col(x) * times).cast("bigint").alias(x) for x in ("pos", "neu", "neg")],
        F.sum(F.col("score") * times).alias("total"),
    )


def sentiment_summary_all_keywords(
    c: Corpus, lexicon: DataFrame, tokenizer: Tokenizer | None = None,
    clause_regex: str = CLAUSE_REGEX,
) -> DataFrame:
    """The summary of every keyword in one job."""
    mean = F.col("total") / F.col("n")
    return _keyword_sums(c, lexicon, tokenizer, clause_regex).select(
        "keyword", "n", "pos", "neu", "neg",
        F.round(F.col("pos") / F.col("n"), 3).alias("pos_share"),
        F.round(F.col("neg") / F.col("n"), 3).alias("neg_share"),
        F.round(mean, 3).alias("mean_score"), label_for(mean).alias("tendency"),
    ).orderBy("keyword")


def sentiment_by_day_all_keywords(
    c: Corpus, lexicon: DataFrame, tokenizer: Tokenizer | None = None,
    clause_regex: str = CLAUSE_REGEX,
) -> DataFrame:
    """Mean score and label counts per publish day (UTC) of every keyword in one job."""
    sums = _keyword_sums(c, lexicon, tokenizer, clause_regex, ["day"])
    return sums.where(F.col("day").isNotNull()).select(
        "keyword", "day", "n", F.round(F.col("total") / F.col("n"), 3).alias("mean_score"),
        "pos", "neu", "neg",
    ).orderBy("keyword", "day")
