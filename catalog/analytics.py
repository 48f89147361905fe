"""Views, joins, aggregates and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import duck
from catalog.registry import query
from hearsay.operators import coverage as C, metrics as M, retrieve as R, views as V
from hearsay.operators.views import COMMENT_COLUMNS, POST_COLUMNS
from hearsay.schema import PLATFORMS
from hearsay.session import scratch_path

KW = "1-URGENT"
RUN = 199711  # first-priority zhihu links of 1997
DAY = "strftime(make_timestamp({} * 1000000), '%Y-%m-%d')"
TEXT = "strftime(make_timestamp({} * 1000000), '%Y-%m-%d %H:%M:%S')"
POSTS = ", ".join(POST_COLUMNS)
COMMENTS = ", ".join(COMMENT_COLUMNS)

# Join of links and posts through the platform pairs they stand for.
PAIRS = """
SELECT * FROM (VALUES ('bili', 'bili'), ('zhihu', 'zhihu_question'),
  ('zhihu', 'zhihu_answer'), ('weibo', 'weibo'), ('tieba', 'tieba')) p(lp, up)"""
LINKED = f"""
SELECT kp.keyword, kp.run_id, {', '.join('p.' + c for c in POST_COLUMNS)}
FROM fx_links kp JOIN pairs ON kp.platform = pairs.lp
JOIN fx_posts p ON p.platform = pairs.up AND p.post_id = kp.post_id"""
ANSWER_IDS = """
SELECT DISTINCT kp.keyword, kp.run_id, CAST(a.id AS VARCHAR) AS post_id
FROM fx_answers a JOIN fx_links kp
ON kp.platform = 'zhihu' AND kp.post_id = CAST(a.question_id AS VARCHAR)"""
COMMENT_KEYS = """
SELECT kp.keyword, kp.run_id, 'bili' AS platform, CAST(v.aid AS VARCHAR) AS post_id
FROM fx_links kp JOIN fx_videos v ON kp.platform = 'bili' AND v.bvid = kp.post_id
UNION SELECT keyword, run_id, 'zhihu_answer', post_id FROM answer_ids
UNION SELECT keyword, run_id, platform, post_id FROM fx_links
WHERE platform IN ('weibo', 'tieba')"""


def sql(text: str, *parts: str) -> str:
    named = {"pairs": PAIRS, "linked": LINKED, "answer_ids": ANSWER_IDS,
             "comment_keys": COMMENT_KEYS}
    return duck(text, **{p: named[p] for p in parts})


# ---- views ------------------------------------------------------------------------------

query("posts_unified", sql(f"SELECT {POSTS} FROM fx_posts"))(
    lambda f: V.posts_unified(f.tables))
query("comments_unified", sql(f"SELECT {COMMENTS} FROM fx_comments"))(
    lambda f: V.comments_unified(f.tables))
query("keyword_posts_unified", sql("""
SELECT kp.keyword, kp.platform, kp.post_id, kp.run_id, kp.rank, r.started_at AS run_started_at
FROM fx_links kp LEFT JOIN fx_runs r USING (run_id)"""))(
    lambda f: V.keyword_posts_unified(f.fx_links, f.fx_runs))

# ---- retrieval --------------------------------------------------------------------------

query("posts_for_keyword", sql(
    f"SELECT {POSTS} FROM linked WHERE keyword = '{KW}'", "pairs", "linked"))(
    lambda f: R.posts_for_keyword(f.corpus, KW))
query("posts_for_keyword_platforms", sql(
    f"SELECT {POSTS} FROM linked WHERE keyword = '{KW}' "
    "AND (platform = 'bili' OR platform = 'weibo')", "pairs", "linked"))(
    lambda f: R.posts_for_keyword(f.corpus, KW, platforms=["bili", "weibo"]))
query("posts_for_keyword_distinct", sql(
    f"SELECT DISTINCT {POSTS} FROM linked WHERE keyword = '{KW}'", "pairs", "linked"))(
    lambda f: R.posts_for_keyword(f.corpus, KW, distinct_posts=True))
query("posts_recent_days", sql(
    f"SELECT {POSTS} FROM linked WHERE keyword = '{KW}' "
    f"AND published_at >= 820454400 - 200 * 86400", "pairs", "linked"))(
    lambda f: R.recent(R.posts_for_keyword(f.corpus, KW), 820454400, 200))
query("answers_for_keyword", sql(
    f"SELECT {POSTS} FROM fx_posts WHERE platform = 'zhihu_answer' AND post_id IN "
    f"(SELECT post_id FROM answer_ids WHERE keyword = '{KW}')", "answer_ids"))(
    lambda f: R.answers_for_keyword(f.corpus, KW))
query("comments_for_post", sql(
    f"SELECT {COMMENTS} FROM fx_comments WHERE post_id = '8'"))(
    lambda f: R.comments_for_post(f.corpus, "8"))
query("comments_for_keyword", sql(
    f"SELECT {COMMENTS} FROM fx_comments WHERE (platform, post_id) IN "
    f"(SELECT (platform, post_id) FROM comment_keys WHERE keyword = '{KW}')",
    "answer_ids", "comment_keys"))(
    lambda f: R.comments_for_keyword(f.corpus, KW))
query("posts_for_run", sql(
    f"SELECT DISTINCT {POSTS} FROM linked WHERE run_id = {RUN} UNION ALL "
    f"SELECT {POSTS} FROM fx_posts WHERE platform = 'zhihu_answer' AND post_id IN "
    f"(SELECT post_id FROM answer_ids WHERE run_id = {RUN})", "pairs", "linked", "answer_ids"))(
    lambda f: R.posts_for_run(f.corpus, RUN))
query("comments_for_run", sql(
    f"SELECT {COMMENTS} FROM fx_comments WHERE (platform, post_id) IN "
    f"(SELECT (platform, post_id) FROM comment_keys WHERE run_id = {RUN})",
    "answer_ids", "comment_keys"))(
    lambda f: R.comments_for_run(f.corpus, RUN))
query("last_linked_posts", sql("""
SELECT kp.platform, kp.post_id, p.title, kp.keyword, kp.run_id, kp.fetched_at
FROM fx_links kp LEFT JOIN fx_posts p ON p.post_id = kp.post_id
  AND p.platform = CASE kp.platform WHEN 'zhihu' THEN 'zhihu_question' ELSE kp.platform END
ORDER BY kp.fetched_at DESC NULLS LAST, kp.keyword, kp.platform, kp.post_id, kp.run_id
LIMIT 10"""))(lambda f: R.last_linked_posts(f.corpus, 10))
query("record_lookup", sql("SELECT * FROM fx_zhihu_questions WHERE id = 11"))(
    lambda f: R.record_lookup(f.tables, "question", "11"))
query("top_comments_per_post", sql("""
SELECT platform, post_id, comment_id, like_count, content, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY platform, post_id
    ORDER BY like_count DESC NULLS LAST, comment_id) AS INT) AS rank FROM fx_comments)
WHERE rank <= 5"""))(
    lambda f: R.top_comments_per_post(f.fx_comments, 5).select(
        "platform", "post_id", "comment_id", "like_count", "content", "rank"))
query("first_floors_per_thread", sql("""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY post_id
  ORDER BY floor NULLS FIRST, comment_id) AS INT) AS rank FROM fx_replies)
WHERE rank <= 3"""))(lambda f: R.first_floors(f.fx_replies, 3))
query("run_summary", sql(f"""
SELECT run_id, keyword, platform, requested_count, posts_fetched, comments_fetched,
  {TEXT.format('started_at')} AS started, {TEXT.format('finished_at')} AS finished, error
FROM fx_runs WHERE keyword = '{KW}'"""))(lambda f: R.run_summary(f.fx_runs, KW))
query("recent_runs", sql(f"""
SELECT run_id, keyword, platform, posts_fetched, comments_fetched,
  {TEXT.format('started_at')} AS started, COALESCE(finished_at - started_at, 0) AS duration,
  error IS NULL AS ok, error
FROM fx_runs ORDER BY run_id DESC LIMIT 5"""))(lambda f: R.recent_runs(f.fx_runs))

# ---- aggregates -------------------------------------------------------------------------

VOLUME = f"""
  {DAY.format('published_at')} AS day, platform, count(*) AS n_posts,
  CAST(COALESCE(sum(comment_count), 0) AS BIGINT) AS total_comments,
  CAST(COALESCE(sum(like_count), 0) AS BIGINT) AS total_likes,
  CAST(COALESCE(sum(favorite_count), 0) AS BIGINT) AS total_favorites,
  CAST(COALESCE(sum(view_count), 0) AS BIGINT) AS total_views"""
query("volume_by_day", sql(f"""
SELECT {VOLUME} FROM linked WHERE keyword = '{KW}' AND published_at IS NOT NULL
GROUP BY 1, 2""", "pairs", "linked"))(lambda f: M.volume_by_day(f.corpus, KW))
query("volume_by_day_all_keywords", sql(f"""
SELECT keyword, {VOLUME} FROM linked WHERE published_at IS NOT NULL
GROUP BY 1, 2, 3""", "pairs", "linked"))(lambda f: M.volume_by_day_all_keywords(f.corpus))
query("volume_pivot", sql(f"""
SELECT {DAY.format('published_at')} AS day, {', '.join(
    f"count(*) FILTER (platform = '{p}') AS {p}" for p in PLATFORMS)}
FROM linked WHERE keyword = '{KW}' AND published_at IS NOT NULL
GROUP BY 1""", "pairs", "linked"))(lambda f: M.volume_pivot(f.corpus, KW))
query("overview_kpis", sql(f"""
SELECT count(*) AS n_posts, {', '.join(
    f"count(*) FILTER (platform = '{p}') AS n_{p}" for p in PLATFORMS)},
  CAST(sum(COALESCE(comment_count, 0)) AS BIGINT) AS total_comments,
  CAST(sum(COALESCE(like_count, 0)) AS BIGINT) AS total_likes,
  CAST(sum(COALESCE(view_count, 0)) AS BIGINT) AS total_views,
  {DAY.format('min(published_at)')} AS first_day, {DAY.format('max(published_at)')} AS last_day
FROM linked WHERE keyword = '{KW}'""", "pairs", "linked"))(
    lambda f: M.overview_kpis(f.corpus, KW))
query("overview_kpis_all_keywords", sql(f"""
SELECT keyword, count(*) AS n_posts, {', '.join(
    f"count(*) FILTER (platform = '{p}') AS n_{p}" for p in PLATFORMS)},
  CAST(sum(COALESCE(comment_count, 0)) AS BIGINT) AS total_comments,
  CAST(sum(COALESCE(like_count, 0)) AS BIGINT) AS total_likes,
  CAST(sum(COALESCE(view_count, 0)) AS BIGINT) AS total_views,
  {DAY.format('min(published_at)')} AS first_day, {DAY.format('max(published_at)')} AS last_day
FROM linked GROUP BY keyword""", "pairs", "linked"))(
    lambda f: M.overview_kpis_all_keywords(f.corpus))
query("platform_counts", sql(f"""
SELECT platform, count(*) AS n_posts FROM linked WHERE keyword = '{KW}' GROUP BY 1""",
    "pairs", "linked"))(lambda f: M.platform_counts(f.corpus, KW))
METRICS = ["comment_count", "like_count", "favorite_count", "view_count"]
query("platform_comparison", sql(" UNION ALL ".join(f"""
SELECT '{m}' AS metric, replace(replace(platform, '_question', ''), '_answer', '') AS platform,
  CAST(COALESCE(sum({m}), 0) AS BIGINT) AS total FROM linked WHERE keyword = '{KW}'
GROUP BY 2""" for m in METRICS), "pairs", "linked"))(
    lambda f: M.platform_comparison(f.corpus, KW))
query("platform_comparison_all_keywords", sql(" UNION ALL ".join(f"""
SELECT keyword, '{m}' AS metric,
  replace(replace(platform, '_question', ''), '_answer', '') AS platform,
  CAST(COALESCE(sum({m}), 0) AS BIGINT) AS total FROM linked
GROUP BY 1, 3""" for m in METRICS), "pairs", "linked"))(
    lambda f: M.platform_comparison_all_keywords(f.corpus))
query("engagement_histogram_all_keywords", sql("""
SELECT keyword, bin, round(exp(lo + bin * step), 6) AS left_edge,
  round(exp(lo + (bin + 1) * step), 6) AS right_edge, count(*) AS n
FROM (SELECT keyword, lo, step, CAST(greatest(0, least(28, floor((ln(v) - lo) / step))) AS BIGINT)
        AS bin
      FROM (SELECT *, ln(min(v) OVER k) AS lo,
              (ln(max(v) OVER k + 1) - ln(min(v) OVER k)) / 29 AS step
            FROM (SELECT keyword, CAST(like_count AS DOUBLE) AS v FROM linked WHERE like_count > 0
                  UNION ALL SELECT a.keyword, p.like_count FROM fx_posts p
                  JOIN (SELECT DISTINCT keyword, post_id FROM answer_ids) a USING (post_id)
                  WHERE platform = 'zhihu_answer' AND like_count > 0)
            WINDOW k AS (PARTITION BY keyword)))
GROUP BY keyword, bin, lo, step""", "pairs", "linked", "answer_ids"))(
    lambda f: M.engagement_histogram_all_keywords(f.corpus))
query("engagement_histogram", sql(f"""
, vals AS (
  SELECT CAST(like_count AS DOUBLE) AS v FROM linked WHERE keyword = '{KW}' AND like_count > 0
  UNION ALL SELECT like_count FROM fx_posts WHERE platform = 'zhihu_answer' AND like_count > 0
    AND post_id IN (SELECT post_id FROM answer_ids WHERE keyword = '{KW}')),
rng AS (SELECT ln(min(v)) AS lo, (ln(max(v) + 1) - ln(min(v))) / 29 AS step FROM vals)
SELECT bin, round(exp(lo + bin * step), 6) AS left_edge,
  round(exp(lo + (bin + 1) * step), 6) AS right_edge, count(*) AS n
FROM (SELECT CAST(greatest(0, least(28, floor((ln(v) - lo) / step))) AS BIGINT) AS bin, lo, step
      FROM vals, rng) GROUP BY bin, lo, step""", "pairs", "linked", "answer_ids")
      .replace(")\n, vals", "),\nvals").replace("\n),\nvals", "\n),\nvals"))(
    lambda f: M.engagement_histogram(f.corpus, KW))
query("keyword_coverage", sql("""
SELECT count(DISTINCT keyword) AS n_keywords, count(DISTINCT post_id) AS n_posts
FROM fx_links"""))(lambda f: M.keyword_coverage(f.fx_links))


def stored_coverage(f):
    """Sketches of the links, stored in three batches of which one is written twice."""
    root = scratch_path(f.spark, "coverage")
    for batch in (0, 1, 2, 1):
        part = f.fx_links.where(F.pmod("rank", F.lit(3)) == batch)
        C.store_sketches(part, root, batch)
    return C.stored_sketches(f.spark, root)


@query("keyword_coverage_sketch", sql("""
SELECT keyword, count(DISTINCT post_id) AS n_exact, true AS within_error
FROM fx_links GROUP BY 1"""))
def keyword_coverage_sketch(f):
    exact = f.fx_links.groupBy("keyword").agg(F.countDistinct("post_id").alias("n_exact"))
    off = F.abs(F.col("n_posts") - F.col("n_exact"))
    return C.coverage(stored_coverage(f)).join(exact, "keyword").select(
        "keyword", "n_exact",
        (off <= F.ceil(C.stated_error() * F.col("n_exact"))).alias("within_error"))


# The days of a year are small sets, which sketches count exactly.
query("coverage_by_day_sketch", sql(f"""
SELECT {DAY.format('fetched_at')} AS day, count(DISTINCT post_id) AS n_posts FROM fx_links
WHERE {DAY.format('fetched_at')} BETWEEN '1996-01-01' AND '1996-12-31' GROUP BY 1"""))(
    lambda f: C.coverage(stored_coverage(f), ["day"], "1996-01-01", "1996-12-31"))
query("top_linked_keywords", sql("""
SELECT keyword, count(*) AS n_links FROM fx_links GROUP BY 1
ORDER BY n_links DESC, keyword LIMIT 5"""))(lambda f: M.top_linked_keywords(f.fx_links))
query("engagement_history", sql(f"""
SELECT platform, post_id, {TEXT.format('fetched_at')} AS snapshot_time, view_count, like_count,
  comment_count, favorite_count, share_count FROM fx_snapshots WHERE post_id = '8'"""))(
    lambda f: M.engagement_history(f.fx_snapshots, "8"))
query("engagement_growth", sql(f"""
SELECT platform, post_id, fetched_at, fetched_at - prev AS seconds,
  {', '.join(f'{c} - p_{c} AS {c}_delta' for c in M.COUNTERS)},
  {', '.join(f'round(CAST(({c} - p_{c}) * 3600 AS DOUBLE) / (fetched_at - prev), 6) '
             f'AS {c}_per_hour' for c in M.COUNTERS)}
FROM (SELECT *, lag(fetched_at) OVER w AS prev,
        {', '.join(f'lag({c}) OVER w AS p_{c}' for c in M.COUNTERS)}
      FROM fx_snapshots WINDOW w AS (PARTITION BY platform, post_id ORDER BY fetched_at))"""))(
    lambda f: M.engagement_growth(f.fx_snapshots))

# ---- rankings ---------------------------------------------------------------------------

LABEL = """CASE WHEN length(l) > 50 THEN substring(l, 1, 49) || '…' ELSE l END"""
query("top_posts", sql(f"""
SELECT platform, post_id, {LABEL} AS label, view_count FROM (
  SELECT *, COALESCE(title, substring(content, 1, 40), '(no title)') AS l FROM linked
  WHERE keyword = '{KW}' AND view_count IS NOT NULL)
ORDER BY view_count DESC, published_at DESC NULLS LAST, platform, post_id LIMIT 10""",
    "pairs", "linked"))(lambda f: M.top_posts(f.corpus, KW, "view_count", 10))
query("top_posts_all_keywords", sql(f"""
SELECT keyword, CAST(rank AS INT) AS rank, platform, post_id, {LABEL} AS label, comment_count
FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY comment_count DESC,
        published_at DESC NULLS LAST, platform, post_id) AS rank FROM (
  SELECT DISTINCT keyword, platform, post_id, published_at, comment_count,
    COALESCE(title, substring(content, 1, 40), '(no title)') AS l FROM linked
  WHERE comment_count IS NOT NULL)) WHERE rank <= 10""", "pairs", "linked"))(
    lambda f: M.top_posts_all_keywords(f.corpus))
query("posts_table_top15", sql(f"""
SELECT platform, post_id, title, comment_count, like_count, view_count FROM linked
WHERE keyword = '{KW}' ORDER BY comment_count DESC NULLS LAST, like_count DESC NULLS LAST,
  platform, post_id LIMIT 15""", "pairs", "linked"))(lambda f: M.posts_table(f.corpus, KW))
query("top_answers", sql(f"""
SELECT post_id, author_name, like_count, comment_count, content FROM fx_posts
WHERE platform = 'zhihu_answer'
  AND post_id IN (SELECT post_id FROM answer_ids WHERE keyword = '{KW}')
ORDER BY like_count DESC NULLS LAST, post_id LIMIT 5""", "answer_ids"))(
    lambda f: M.top_answers(f.corpus, KW))
query("sample_posts_with_top_comment", sql(f"""
SELECT b.platform, b.post_id, b.url, COALESCE(b.author_name, '?') AS author,
  substring(COALESCE(b.title, '(no title)'), 1, 120) AS title,
  COALESCE(b.like_count, 0) AS likes, COALESCE(b.comment_count, 0) AS comments,
  substring(COALESCE(b.content, ''), 1, 300)
    || CASE WHEN length(b.content) > 300 THEN '…' ELSE '' END AS preview,
  c.author_name AS top_comment_author, COALESCE(c.like_count, 0) AS top_comment_likes,
  substring(c.content, 1, 200) AS top_comment
FROM (SELECT * FROM linked WHERE keyword = '{KW}' AND like_count IS NOT NULL
      ORDER BY like_count DESC, published_at DESC NULLS LAST, platform, post_id LIMIT 5) b
LEFT JOIN fx_videos v ON b.platform = 'bili' AND v.bvid = b.post_id
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY platform, post_id
             ORDER BY like_count DESC NULLS LAST, comment_id) AS r FROM fx_comments) c
  ON c.r = 1 AND c.platform = b.platform
  AND c.post_id = COALESCE(CAST(v.aid AS VARCHAR), b.post_id)""", "pairs", "linked"))(
    lambda f: M.sample_posts_with_top_comment(f.corpus, KW))
