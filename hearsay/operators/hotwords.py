"""TF-IDF hot words and token counts."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from hearsay.functions.text import (
    CJK_REGEX, Tokenizer, clean_text, is_word, regex_tokenizer,
)
from hearsay.operators.chains import stored


def explode_tokens(
    units: DataFrame, keys: Sequence[str], text: str, tokenizer: Tokenizer | None = None
) -> DataFrame:
    """One row per token occurrence of a whole text."""
    tokenizer = tokenizer or regex_tokenizer()
    return units.select(*keys, F.explode(tokenizer(F.col(text))).alias("word")).withColumn(
        "word", F.trim("word")
    )


def token_counts(
    units: DataFrame, text: str, tokenizer: Tokenizer | None = None,
    stopwords: DataFrame | None = None, must_contain: str = CJK_REGEX, min_length: int = 2,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Occurrences per word (and key), noise and stopwords dropped.

    Words are counted map-side before anything moves; stopwords (a table ``word``) are removed
    from the counted words, not from every occurrence.
    """
    words = explode_tokens(units, keys, text, tokenizer)
    counted = (
        words.where(is_word(F.col("word"), must_contain, min_length))
        .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    )
    if stopwords is not None:
        counted = counted.join(stopwords.select("word").distinct(), "word", "left_anti")
    return counted.select(*keys, "word", "n")


def corpus_idf(documents: DataFrame, doc_key: Sequence[str], text: str,
               tokenizer: Tokenizer | None = None) -> DataFrame:
    """Table (word, idf) with idf = ln((N + 1) / (df + 1)) over the documents.

    A word counts once per document: repeats are removed within the document's own array,
    before the explode, so no shuffle is needed for that.
    """
    tokenizer = tokenizer or regex_tokenizer()
    total = documents.agg(F.count(F.lit(1))).scalar()
    words = documents.select(F.explode(F.array_distinct(tokenizer(F.col(text)))).alias("word"))
    return (
        words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        .select("word", F.ln((total + 1) / (F.col("df") + 1)).alias("idf"))
    )


def word_counts(
    units: DataFrame, text: str, tokenizer: Tokenizer | None = None, weight: str | None = None
) -> DataFrame:
    """Table (word, n, df) of a corpus: occurrences, and texts with the word.

    The row of the empty word counts the non-blank texts. ``weight`` names a multiplicity
    column. Words have two or more characters.
    """
    tokenizer = tokenizer or regex_tokenizer()
    times = F.col(weight) if weight else F.lit(1).cast("bigint")
    # Sorted tokens next to their predecessor: the first of equal neighbours counts for df,
    # so tf and df come from one explode and one map-side combined aggregate. An empty word
    # per non-blank text counts the texts in the same pass.
    marks = F.when(F.trim(text) != "", F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    found = F.sort_array(F.filter(tokenizer(F.col(text)), lambda t: F.char_length(t) >= 2))
    # A column of its own: a generator computes what it names twice, twice.
    listed = units.select(times.alias("_times"), F.concat(marks, found).alias("_words"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("_words"))
    pairs = F.arrays_zip(F.col("_words").alias("word"), before.alias("last"))
    tokens = listed.select("_times", F.explode(pairs).alias("t")).select(
        "_times", "t.*"
    ).where(F.col("word").isNotNull())
    starts = F.col("last").isNull() | (F.col("last") != F.col("word"))
    return tokens.groupBy("word").agg(
        F.sum("_times").alias("n"), F.sum(F.when(starts, F.col("_times"))).alias("df")
    )


def top_keywords(
    counts: DataFrame, k: int = 30, tokenizer: Tokenizer | None = None,
    idf: DataFrame | None = None, stopwords: DataFrame | None = None,
    exclude: Sequence[str] = (), must_contain: str = CJK_REGEX, min_length: int = 2,
) -> DataFrame:
    """Hot words: (word, weight), heaviest first, at most ``k``, from :func:`word_counts`.

    tf is the share of a word among all tokens of two or more characters. ``idf`` is a table
    (word, idf); unseen words take its median. Without one, the document frequencies of the
    corpus itself serve. Noise, stopwords and ``exclude`` (cleaned as texts are) go before the
    ``k`` heaviest are taken. The corpus is never put together in one place.

    The counts are read for the totals and for the weights. They are stored first, a row per word:
    the plans of the totals do not share the aggregate with that of the weights, so the texts
    would be cleaned and cut once for each.
    """
    tokenizer = tokenizer or regex_tokenizer()
    counted = stored(counts, "word-counts")
    is_mark = F.col("word") == ""
    total = counted.agg(F.sum(F.when(~is_mark, F.col("n")))).scalar()
    if idf is None:
        n_texts = counted.agg(F.sum(F.when(is_mark, F.col("df")))).scalar()
        weighed = counted.withColumn("idf", F.ln((n_texts + 1) / (F.col("df") + 1)))
    else:
        median = idf.agg(F.percentile_approx("idf", 0.5)).scalar()
        weighed = counted.join(idf.select("word", "idf"), "word", "left").withColumn(
            "idf", F.coalesce("idf", median)
        )
    score = F.round(F.col("n") * F.col("idf") / total, 9)
    candidates = weighed.where(~is_mark & is_word(F.col("word"), must_contain, min_length)).select(
        "word", score.alias("weight"))
    if stopwords is not None:
        candidates = candidates.join(stopwords.select("word").distinct(), "word", "left_anti")
    if exclude:
        spark = counts.sparkSession
        terms = spark.range(1).select(F.explode(F.array(*map(F.lit, exclude))).alias("term"))
        terms = terms.select(clean_text(F.col("term")).alias("term"))
        dropped = terms.select("term").unionByName(
            terms.select(F.explode(tokenizer(F.col("term"))).alias("term"))
        ).select(F.col("term").alias("word"))
        candidates = candidates.join(dropped, "word", "left_anti")
    return candidates.orderBy(F.desc("weight"), "word").limit(k).select("word", "weight")
