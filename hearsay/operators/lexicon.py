"""Building and checking a sentiment lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Raw category -> bucket, with the bounds of its weights and shortest term.
CATEGORIES = {
    "pos-general": "positive",
    "pos-domain": "positive",
    "neg-general": "negative",
    "neg-domain": "negative",
    "degree": "degree",
    "negation": "negation",
    "stopwords": "stopword",
}
BOUNDS = {"positive": (1.0, 2.0), "negative": (1.0, 2.0), "degree": (0.3, 2.5)}
MIN_LENGTH = {"positive": 2, "negative": 2}
TERM_REGEX = "^[一-鿿㐀-䶿]+$"


def read_raw_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Rows (category, term, value) from JSON of the form {category: [{term, value}, ...]},
    plain or under "result"."""
    body = F.try_parse_json(F.col("value"))
    categories = F.coalesce(
        F.try_variant_get(body, "$.result", "map<string,variant>"),
        F.try_variant_get(body, "$", "map<string,variant>"),
    )
    items = (
        spark.read.text(path, wholetext=True)
        .select(F.explode(categories).alias("category", "items"))
        .select("category", F.explode(
            F.try_variant_get("items", "$", "array<variant>")).alias("item"))
    )
    return items.select(
        "category",
        F.try_variant_get("item", "$.term", "string").alias("term"),
        F.coalesce(F.try_variant_get("item", "$.value", "string"), F.lit("1.0")).alias("value"),
    )


def lexicon_build(
    raw: DataFrame, term_regex: str = TERM_REGEX, stopwords: DataFrame | None = None
) -> DataFrame:
    """Clean rows (category, term, value text) into the lexicon (bucket, term, value).

    ``stopwords`` (a table ``word``) are stopwords whatever ``raw`` says.

    Terms must match ``term_regex`` and the bucket's shortest length; weights are numbers,
    clamped and rounded to two places, the largest one kept. A term with both polarities is
    dropped from both; a degree word that carries sentiment or negates is no degree word.
    Everything is decided in one aggregate per term, whose groups are combined map-side.
    """
    bucket = F.element_at(
        F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), F.col("category")
    )
    rows = raw.select(bucket.alias("bucket"), F.trim("term").alias("term"),
                      F.col("value").try_cast("double").alias("value"))
    shortest = F.lit(1)
    for name, n in MIN_LENGTH.items():
        shortest = F.when(F.col("bucket") == name, n).otherwise(shortest)
    rows = rows.where(F.col("term").rlike(term_regex) & (F.char_length("term") >= shortest))

    def largest(name: str) -> Column:
        low, high = BOUNDS[name]
        value = F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.col("value"))), 2)
        return F.max(F.when((F.col("bucket") == name) & F.col("value").isNotNull()
                            & ~F.isnan("value"), value))

    def present(name: str) -> Column:
        return F.max(F.when(F.col("bucket") == name, F.lit(1.0)))

    if stopwords is not None:
        rows = rows.unionByName(stopwords.select(
            F.lit("stopword").alias("bucket"), F.col("word").alias("term"),
            F.lit(1.0).alias("value")))
    per_term = rows.groupBy("term").agg(
        *[largest(b).alias(b) for b in BOUNDS],
        present("negation").alias("negation"), present("stopword").alias("stopword"),
    )
    both = F.col("positive").isNotNull() & F.col("negative").isNotNull()
    pos = F.when(~both, F.col("positive"))
    neg = F.when(~both, F.col("negative"))
    no_degree = pos.isNotNull() | neg.isNotNull() | F.col("negation").isNotNull()
    decided = per_term.select(
        "term", pos.alias("positive"), neg.alias("negative"),
        F.when(~no_degree, F.col("degree")).alias("degree"), "negation", "stopword",
    )
    buckets = ["positive", "negative", "degree", "negation", "stopword"]
    return (
        decided.unpivot("term", buckets, "bucket", "value")
        .where(F.col("value").isNotNull()).select("bucket", "term", "value")
    )


def lexicon_stats(lexicon: DataFrame) -> DataFrame:
    """Terms per bucket."""
    return lexicon.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_terms")).orderBy("bucket")


def dictionary_words(lexicon: DataFrame, max_words: int = 1_000_000) -> list[str]:
    """Scoring terms of two or more characters, for a max-match tokenizer.

    They go to every task, so more than ``max_words`` is an error.
    """
    words = (
        lexicon.where(F.col("bucket").isin("positive", "negative", "degree")
                      & (F.char_length("term") >= 2))
        .select("term").distinct().limit(max_words + 1).collect()
    )
    if len(words) > max_words:
        raise ValueError(f"more than {max_words} dictionary words")
    return [w.term for w in words]
