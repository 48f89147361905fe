"""Everything a keyword report shows, as tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from hearsay.functions.text import CJK_REGEX, CLAUSE_REGEX, Tokenizer
from hearsay.operators import hotwords, metrics, retrieve, sentiment
from hearsay.operators.retrieve import Corpus
from hearsay.schema import to_zh


@dataclass
class Report:
    """Lazy report tables by name, and what was persisted for them."""

    tables: dict[str, DataFrame]
    persisted: list[DataFrame] = field(default_factory=list)
    corpus: Corpus | None = None

    def release(self) -> None:
        for df in self.persisted:
            df.unpersist()
        if self.corpus is not None:
            self.corpus.release()

    def write(self, path: str, fmt: str = "parquet", chinese: bool = False) -> None:
        """One folder per table below ``path``."""
        for name, df in self.tables.items():
            (to_zh(df) if chinese else df).write.mode("overwrite").format(fmt).save(
                f"{path}/{name}"
            )


def keyword_report(
    c: Corpus, keyword: str, lexicon: DataFrame, days: int | None = None,
    as_of: int | None = None, tokenizer: Tokenizer | None = None,
    clause_regex: str = CLAUSE_REGEX, idf: DataFrame | None = None,
    stopwords: DataFrame | None = None, must_contain: str = CJK_REGEX, top_words: int = 20,
) -> Report:
    """Tables of the sections overview, volume, sentiment, hot words, top posts, engagement
    distribution, platform comparison, samples and runs.

    ``days`` keeps posts and comments published within that many days before ``as_of``.
    Texts are scored once for all sentiment tables. The keyword's links are persisted and
    measured first (see ``Corpus.measure_keys``), as every table starts from them.
    """
    c = replace(c, measure_keys=True, measured=[])
    if days is not None:
        if as_of is None:
            raise ValueError("days needs as_of, the epoch seconds to count back from")
        c = replace(c, posts=retrieve.recent(c.posts, as_of, days),
                    comments=retrieve.recent(c.comments, as_of, days))
    scored = sentiment.scored_units(
        c, keyword, lexicon, tokenizer=tokenizer, clause_regex=clause_regex
    ).persist(StorageLevel.MEMORY_AND_DISK)
    units = sentiment.text_units(c, F.col("keyword") == keyword)
    counts = hotwords.word_counts(units, "text", tokenizer, weight="n_links")
    tables = {
        "overview": metrics.overview_kpis(c, keyword),
        "platform_counts": metrics.platform_counts(c, keyword),
        "volume_by_day": metrics.volume_by_day(c, keyword),
        "volume_pivot": metrics.volume_pivot(c, keyword),
        "sentiment_summary": sentiment.sentiment_summary(scored),
        "sentiment_breakdown": sentiment.sentiment_breakdown(scored),
        "sentiment_by_day": sentiment.sentiment_by_day(scored),
        "hot_words": hotwords.top_keywords(
            counts, top_words, tokenizer, idf, stopwords, [keyword], must_contain
        ),
        **{
            f"top_posts_{m}": metrics.top_posts(c, keyword, m, 8)
            for m in ("like_count", "comment_count", "view_count")
        },
        "engagement_distribution": metrics.engagement_histogram(c, keyword),
        "platform_comparison": metrics.platform_comparison(c, keyword),
        "samples": metrics.sample_posts_with_top_comment(c, keyword),
    }
    if c.runs is not None:
        tables["runs"] = retrieve.run_summary(c.runs, keyword).limit(10)
    return Report(tables, [scored], c)


def all_keywords_report(
    c: Corpus, lexicon: DataFrame, tokenizer: Tokenizer | None = None,
    clause_regex: str = CLAUSE_REGEX,
) -> Report:
    """The tables that exist for all keywords at once; one job each, not one per keyword."""
    return Report({
        "overview": metrics.overview_kpis_all_keywords(c),
        "platform_comparison": metrics.platform_comparison_all_keywords(c),
        "engagement_distribution": metrics.engagement_histogram_all_keywords(c),
        "volume_by_day": metrics.volume_by_day_all_keywords(c),
        "top_posts": metrics.top_posts_all_keywords(c),
        "sentiment_summary": sentiment.sentiment_summary_all_keywords(
            c, lexicon, tokenizer, clause_regex
        ),
        "sentiment_by_day": sentiment.sentiment_by_day_all_keywords(
            c, lexicon, tokenizer, clause_regex
        ),
        "coverage": metrics.keyword_coverage(c.links),
        "top_keywords": metrics.top_linked_keywords(c.links),
    })
