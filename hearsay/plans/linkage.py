"""Landing payloads once, and the links and runs that a batch of them implies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearsay.functions.scalars import first_non_empty
from hearsay.normalize import bili, tieba, weibo, zhihu
from hearsay.normalize.common import get
from hearsay.normalize.responses import HTML_ENDPOINTS, classify
from hearsay.operators.merge import first_wins, open_runs, seen_post_ids, upsert
from hearsay.operators.views import Tables
from hearsay.operators.worklist import worklist

# Where the hits of a keyword come from.
SEARCHES = [("bili", "search"), ("zhihu", "search"), ("weibo", "search"), ("tieba", "forum"),
            ("tieba", "html_search")]
ORDER = ["page_no", "place", "part"]
PARTITIONS = ["platform", "endpoint", "outcome"]


def land(payloads: DataFrame, path: str) -> DataFrame:
    """Classify and parse payloads once and write them by platform, endpoint and outcome.

    The body stays as a variant (``v``); pages that are not JSON keep their text. What is returned
    reads the landed table: whatever looks at one kind of response reads that folder alone, and
    nothing is parsed or classified again.
    """
    kept = F.when(F.col("endpoint").isin(*HTML_ENDPOINTS), F.col("body"))
    classify(payloads, keep_parsed=True).withColumn("body", kept).write.partitionBy(
        *PARTITIONS).parquet(path)
    return payloads.sparkSession.read.parquet(path)


def _of(payloads: DataFrame, platform: str, endpoint: str) -> DataFrame:
    return payloads.where((F.col("platform") == platform) & (F.col("endpoint") == endpoint))


def search_hits(payloads: DataFrame) -> DataFrame:
    """All hits (keyword, platform, post_id, and their order) of the usable search responses of a
    batch. Answers stand for their question."""
    usable = payloads if "outcome" in payloads.columns else classify(payloads)
    usable = usable.where(F.col("outcome") == "OK")
    zero = F.lit(0).cast("bigint")

    def hits(rows: DataFrame, platform: str, post_id, place, page_no=None, part=zero) -> DataFrame:
        page = zero if page_no is None else F.col(page_no).cast("bigint")
        return rows.select(
            "keyword", F.lit(platform).alias("platform"), post_id.cast("string").alias("post_id"),
            page.alias("page_no"), place.cast("bigint").alias("place"),
            part.cast("bigint").alias("part"))

    videos = bili.norm_search(_of(usable, "bili", "search"))
    asked = zhihu.norm_general_search(_of(usable, "zhihu", "search"))
    question = F.when(F.col("kind") == "question", F.col("target_id")).when(
        F.col("kind") == "answer", F.col("parent_id"))
    posts = weibo.norm_cards(_of(usable, "weibo", "search"))
    threads = tieba.norm_forum_feed(_of(usable, "tieba", "forum"))
    pages = _of(usable, "tieba", "html_search").select(
        F.struct("keyword", "page_no").alias("page_id"), F.col("body").alias("html"))
    found = tieba.parse_search_html(pages).select("page_id.*", "tid", "pos")
    return (
        hits(videos, "bili", F.col("bvid"), F.col("rank"))
        .unionByName(hits(asked, "zhihu", F.trim(question).try_cast("bigint"), F.col("pos"),
                          "page_no"))
        .unionByName(hits(posts, "weibo", first_non_empty(get("mblog", "id"), get("mblog", "mid")),
                          F.col("card"), "page_no", F.col("member")))
        .unionByName(hits(threads, "tieba", F.col("tid"), F.col("pos"), "page_no"))
        # Result pages come after the feed of a forum.
        .unionByName(hits(found, "tieba", F.col("tid"), F.col("pos"), "page_no", F.lit(1)))
        .where(F.coalesce("post_id", F.lit("")) != "")
    )


def ingest_runs(payloads: DataFrame, as_of: int, requested: int) -> DataFrame:
    """One open run per keyword and platform that the batch has searched, whatever came back."""
    searched = F.lit(False)
    for platform, endpoint in SEARCHES:
        searched = searched | ((F.col("platform") == platform) & (F.col("endpoint") == endpoint))
    return open_runs(payloads.where(searched).select("keyword", "platform").distinct().select(
        "*", F.lit(requested).cast("bigint").alias("requested_count"),
        F.lit(as_of).cast("bigint").alias("started_at"), F.lit(None).cast("string").alias("config")))


def ingest_links(
    payloads: DataFrame, links: DataFrame, as_of: int, count: int, only_new: bool = True
) -> DataFrame:
    """Link rows of a batch: the first ``count`` distinct posts of every keyword and platform in
    the order of its search results, less those linked before, ranked 1..k, with their run."""
    ranked = worklist(search_hits(payloads), seen_post_ids(links), count, ORDER, only_new)
    runs = ingest_runs(payloads, as_of, count).select("keyword", "platform", "run_id")
    return ranked.join(runs, ["keyword", "platform"]).select(
        "keyword", "platform", "post_id", "run_id", "rank",
        F.lit(as_of).cast("bigint").alias("fetched_at"))


def _posts(batch: Tables) -> DataFrame:
    """Distinct (platform, post_id) of the posts that a batch holds."""
    ids = [("bili", "bili_videos", "bvid"), ("zhihu", "zhihu_questions", "id"),
           ("weibo", "weibo_posts", "id"), ("tieba", "tieba_threads", "tid")]
    out = None
    for platform, table, key in ids:
        one = batch[table].select(
            F.lit(platform).alias("platform"), F.col(key).cast("string").alias("post_id"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _comments(batch: Tables) -> DataFrame:
    """Comments per (platform, post_id) of a batch; answers count as comments of their question,
    and so do theirs. Counted per parent before anything is joined."""
    def per(table: str, key: str, name: str = "post_id") -> DataFrame:
        return batch[table].groupBy(F.col(key).cast("string").alias(name)).agg(
            F.count(F.lit(1)).alias("n"))

    videos = batch["bili_videos"].select("bvid", F.col("aid").cast("string").alias("aid"))
    answers = batch["zhihu_answers"].select(
        F.col("id").cast("string").alias("answer_id"),
        F.col("question_id").cast("string").alias("post_id"))
    parts = {
        "bili": [per("bili_comments", "oid", "aid").join(videos, "aid").select(
            F.col("bvid").alias("post_id"), "n")],
        "zhihu": [per("zhihu_answers", "question_id"),
                  per("zhihu_answer_comments", "answer_id", "answer_id").join(
                      answers, "answer_id").select("post_id", "n")],
        "weibo": [per("weibo_comments", "post_id")],
        "tieba": [per("tieba_comments", "tid")],
    }
    out = None
    for platform, counted in parts.items():
        for one in counted:
            one = one.select(F.lit(platform).alias("platform"), "post_id", "n")
            out = one if out is None else out.unionByName(one)
    return out.groupBy("platform", "post_id").agg(F.sum("n").alias("n"))


def close_ingested(
    runs: DataFrame, payloads: DataFrame, links: DataFrame, batch: Tables, as_of: int
) -> DataFrame:
    """The runs of a batch with what came of them: linked posts and comments that the batch holds,
    and the failure of the first search page, if it failed. ``links`` are the batch's own."""
    found = _posts(batch).withColumn("here", F.lit(1).cast("bigint"))
    counted = (
        links.join(found, ["platform", "post_id"], "left")
        .join(_comments(batch), ["platform", "post_id"], "left")
        .groupBy("run_id").agg(
            F.coalesce(F.sum("here"), F.lit(0)).alias("posts_fetched"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("comments_fetched"))
    )
    classed = payloads if "outcome" in payloads.columns else classify(payloads)
    searched = F.struct("platform", "endpoint").isin(
        *[F.struct(F.lit(p).alias("platform"), F.lit(e).alias("endpoint")) for p, e in SEARCHES])
    first = first_wins(
        classed.where(searched).select("keyword", "platform", "page_no", "endpoint", "outcome"),
        ["keyword", "platform"], ["page_no", "endpoint", "outcome"])
    done = runs.select("run_id", "keyword", "platform").join(counted, "run_id", "left").join(
        first, ["keyword", "platform"], "left").select(
        "run_id", F.lit(as_of).cast("bigint").alias("finished_at"),
        F.coalesce("posts_fetched", F.lit(0)).cast("bigint").alias("posts_fetched"),
        F.coalesce("comments_fetched", F.lit(0)).cast("bigint").alias("comments_fetched"),
        F.when(F.col("outcome") != "OK", F.col("outcome")).alias("error"))
    return upsert(runs, done, ["run_id"], "finished_at", kept=())
