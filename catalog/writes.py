"""Merges, work-lists, run bookkeeping, scans and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import LP, duck
from catalog.registry import query
from hearsay.operators import merge as G, worklist as W
from hearsay.schema import SCHEMAS
from hearsay.session import scratch_path
from hearsay.sources import buckets as BK, generations as GN, sinks, tables as T

DAY_START = "EPOCH({0}) - EPOCH({0}) % 86400"


def both(f, sql: str, **frames):
    """Run a shared input text in Spark; EPOCH and STRING as in the adapters."""
    import re
    text = re.sub(r"EPOCH\((\w+)\)", r"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', "
                  r"CAST(\1 AS TIMESTAMP_NTZ))", sql)
    return f.spark.sql(text, **frames)


def ddb(sql: str) -> str:
    import re
    text = re.sub(r"EPOCH\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", sql)
    return re.sub(r"\{(\w+)\}", r"\1", text).replace("AS STRING", "AS VARCHAR")


# ---- merges -----------------------------------------------------------------------------

BASE = """
SELECT CAST(c_custkey AS STRING) AS id, c_name AS title, c_mktsegment AS content,
  CAST(c_nationkey AS BIGINT) AS likes, CAST(c_custkey AS BIGINT) AS fetched_at
FROM {customer} WHERE c_acctbal >= 0"""
UPDATES = """
SELECT CAST(o_custkey AS STRING) AS id,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS content,
  CAST(floor(o_totalprice) AS BIGINT) AS likes, EPOCH(o_orderdate) AS fetched_at,
  o_orderkey AS seq FROM {orders}"""
MERGED = {
    "base": ddb(BASE), "upd": ddb(UPDATES),
    "last": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r "
            "FROM upd) WHERE r = 1",
    "first": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r "
             "FROM upd) WHERE r = 1",
    "lastset": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) "
               "AS r FROM upd WHERE content IS NOT NULL) WHERE r = 1",
}


def merged_sql(content: str) -> str:
    return duck(f"""
SELECT COALESCE(b.id, l.id) AS id, b.title, {content} AS content,
  COALESCE(l.likes, b.likes) AS likes, COALESCE(b.fetched_at, f.fetched_at) AS fetched_at
FROM base b FULL JOIN last l ON b.id = l.id LEFT JOIN first f ON f.id = l.id
LEFT JOIN lastset s ON s.id = COALESCE(b.id, l.id)""", **MERGED)


query("upsert_merge", merged_sql("CASE WHEN l.id IS NULL THEN b.content ELSE l.content END"))(
    lambda f: G.upsert(both(f, BASE, customer=f.customer), both(f, UPDATES, orders=f.orders),
                       ["id"], "seq"))
query("upsert_merge_keep_nulls", merged_sql("COALESCE(s.content, b.content)"))(
    lambda f: G.upsert(both(f, BASE, customer=f.customer), both(f, UPDATES, orders=f.orders),
                       ["id"], "seq", null_overwrites=False))


@query("upsert_touched_buckets", merged_sql(
    "CASE WHEN l.id IS NULL THEN b.content ELSE l.content END"))
def upsert_touched_buckets(f):
    # The table is written in buckets; the older half of the updates is merged, then the newer.
    root = scratch_path(f.spark, "buckets")
    BK.create(both(f, BASE, customer=f.customer), root, ["id"], 16)
    updates = both(f, UPDATES, orders=f.orders)
    half = updates.agg(F.expr("max(seq) div 2")).first()[0]
    BK.merge(f.spark, root, updates.where(F.col("seq") <= half), "seq")
    BK.merge(f.spark, root, updates.where(F.col("seq") > half), "seq")
    return BK.read(f.spark, root)


query("upsert_latest_wins", duck(
    "SELECT id, content, likes, fetched_at, seq FROM last", **MERGED))(
    lambda f: G.latest_wins(both(f, UPDATES, orders=f.orders), ["id"], "seq"))
NEW_LINKS = f"""
SELECT CASE WHEN o_orderstatus = 'F' THEN concat(o_orderpriority, '*') ELSE o_orderpriority END
    AS keyword, {LP('o_custkey')} AS platform, CAST(o_custkey AS STRING) AS post_id,
  CAST(year(o_orderdate) * 100 + CAST(substring(o_orderpriority, 1, 1) AS INT) * 10
    + o_custkey % 5 AS BIGINT) AS run_id, o_orderkey AS rank, EPOCH(o_orderdate) AS fetched_at
FROM {{orders}}"""
query("insert_ignore_links", duck("""
SELECT * FROM fx_links UNION ALL
SELECT keyword, platform, post_id, run_id, rank, fetched_at FROM (
  SELECT *, row_number() OVER (PARTITION BY keyword, platform, post_id, run_id ORDER BY rank) r
  FROM new_links) n
WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM fx_links l WHERE l.keyword = n.keyword
  AND l.platform = n.platform AND l.post_id = n.post_id AND l.run_id = n.run_id)""",
    new_links=ddb(NEW_LINKS)))(
    lambda f: G.insert_ignore(f.fx_links, both(f, NEW_LINKS, orders=f.orders),
                              ["keyword", "platform", "post_id", "run_id"], ["rank"]))
NEW_SNAPS = """
SELECT CASE user_id % 5 WHEN 0 THEN 'bili' WHEN 1 THEN 'zhihu_question' WHEN 2
    THEN 'zhihu_answer' WHEN 3 THEN 'weibo' ELSE 'tieba' END AS platform,
  CAST(user_id AS STRING) AS post_id, EPOCH(ts) - EPOCH(ts) % 21600 AS fetched_at,
  event_id AS view_count, user_id AS like_count, event_id AS comment_count,
  user_id AS favorite_count, event_id AS share_count FROM {events}"""
SNAP = "platform, post_id, fetched_at"
SNAPS = SNAP + ", view_count, like_count, comment_count, favorite_count, share_count"
query("snapshot_dedupe", duck(f"""
SELECT {SNAPS} FROM fx_snapshots UNION ALL SELECT {SNAPS} FROM (
  SELECT *, row_number() OVER (PARTITION BY {SNAP} ORDER BY view_count) AS r FROM new_snaps)
WHERE r = 1 AND ({SNAP}) NOT IN (SELECT ({SNAP}) FROM fx_snapshots)""",
    new_snaps=ddb(NEW_SNAPS)))(
    lambda f: G.append_snapshots(f.fx_snapshots, both(f, NEW_SNAPS, events=f.events),
                                 ["view_count"]))


def run_ledger(f):
    """Open every run, then close those that finished."""
    asked = f.fx_runs.select("keyword", "platform", "requested_count", "started_at",
                             F.lit("{}").alias("config"), "finished_at", "posts_fetched",
                             "comments_fetched", "error")
    opened = G.open_runs(asked)
    done = asked.where(F.col("finished_at").isNotNull()).select(
        F.xxhash64("keyword", "platform", "started_at").alias("run_id"), "finished_at",
        "posts_fetched", "comments_fetched", "error")
    return G.close_runs(opened, done).drop("run_id")


query("run_ledger", duck("""
SELECT keyword, platform, requested_count, started_at, finished_at,
  CASE WHEN finished_at IS NOT NULL THEN posts_fetched END AS posts_fetched,
  CASE WHEN finished_at IS NOT NULL THEN comments_fetched END AS comments_fetched,
  '{}' AS config, CASE WHEN finished_at IS NOT NULL THEN error END AS error
FROM fx_runs"""))(run_ledger)
query("seen_post_ids", duck("""
SELECT DISTINCT keyword, platform, post_id FROM fx_links
WHERE keyword = '1-URGENT' AND platform = 'zhihu'"""))(
    lambda f: G.seen_post_ids(f.fx_links, "1-URGENT", "zhihu"))

# ---- work-lists -------------------------------------------------------------------------

HITS = f"""
SELECT o_orderpriority AS keyword, {LP('o_custkey')} AS platform,
  CAST(o_custkey AS STRING) AS post_id, CAST(floor(o_orderkey / 20) AS BIGINT) AS page_no,
  o_orderkey % 20 AS pos FROM {{orders}}"""
SEEN_BEFORE = 852076800  # 1997-01-01
LISTED = {
    "hits": ddb(HITS),
    "seen": f"SELECT DISTINCT keyword, platform, post_id FROM fx_links "
            f"WHERE fetched_at < {SEEN_BEFORE}",
    "once": "SELECT keyword, platform, post_id, min(page_no * 20 + pos) AS first_at FROM hits "
            "GROUP BY 1, 2, 3",
    "capped": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword, platform "
              "ORDER BY first_at) AS hit FROM once) WHERE hit <= 100",
}


def _seen(f):
    return G.seen_post_ids(f.fx_links.where(F.col("fetched_at") < SEEN_BEFORE))


query("worklist_only_new", duck("""
SELECT keyword, platform, post_id,
  row_number() OVER (PARTITION BY keyword, platform ORDER BY hit) AS rank
FROM capped ANTI JOIN seen USING (keyword, platform, post_id)""", **LISTED))(
    lambda f: W.worklist(both(f, HITS, orders=f.orders), _seen(f), 100, ["page_no", "pos"]))
query("worklist_all", duck(
    "SELECT keyword, platform, post_id, hit AS rank FROM capped", **LISTED))(
    lambda f: W.worklist(both(f, HITS, orders=f.orders), _seen(f), 100, ["page_no", "pos"],
                         only_new=False))
query("worklist_skipped", duck("""
SELECT keyword, platform, count(*) AS capped, count(s.post_id) AS skipped,
  count(*) - count(s.post_id) AS kept
FROM capped LEFT JOIN seen s USING (keyword, platform, post_id) GROUP BY 1, 2""", **LISTED))(
    lambda f: W.worklist_skipped(both(f, HITS, orders=f.orders), _seen(f), 100,
                                 ["page_no", "pos"]))
KINDS = """
SELECT o_orderpriority AS keyword,
  CASE o_orderstatus WHEN 'F' THEN 'question' WHEN 'O' THEN 'answer' ELSE 'people' END AS kind,
  CASE WHEN o_totalprice > 400000 THEN concat('x', CAST(o_custkey AS STRING))
    ELSE CAST(o_custkey AS STRING) END AS target_id,
  CAST(o_custkey + 7 AS STRING) AS parent_id, o_orderkey AS pos FROM {orders}"""
query("hits_to_parents", duck("""
SELECT keyword, question_id, rank FROM (
  SELECT keyword, question_id, row_number() OVER (PARTITION BY keyword ORDER BY min(pos)) AS rank
  FROM (SELECT keyword, pos, TRY_CAST(CASE kind WHEN 'question' THEN target_id
          WHEN 'answer' THEN parent_id END AS BIGINT) AS question_id FROM kinds)
  WHERE question_id IS NOT NULL GROUP BY 1, 2) WHERE rank <= 50""", kinds=ddb(KINDS)))(
    lambda f: W.hits_to_parents(both(f, KINDS, orders=f.orders), 50, ["pos"]))
ITEMS = """
SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS run_id,
  CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'N' THEN 'skipped' ELSE 'failed' END AS outcome,
  CASE WHEN l_returnflag = 'R' THEN CASE l_linestatus WHEN 'F' THEN 'SoftBanned'
    ELSE 'NotFound' END END AS error FROM {lineitem}"""
query("run_outcomes", duck("""
SELECT run_id, count(*) AS requested, count(*) FILTER (outcome = 'ok') AS ok,
  count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped')
  AS skipped FROM items GROUP BY 1""", items=ddb(ITEMS)))(
    lambda f: W.run_outcomes(both(f, ITEMS, lineitem=f.lineitem)))
query("run_error_tally", duck("""
SELECT run_id, error, count(*) AS n FROM items WHERE outcome = 'failed' GROUP BY 1, 2""",
    items=ddb(ITEMS)))(lambda f: W.run_error_tally(both(f, ITEMS, lineitem=f.lineitem)))

# ---- scans and exports ------------------------------------------------------------------

TABLES = ("bili_videos zhihu_questions zhihu_answers weibo_posts tieba_threads bili_comments "
          "zhihu_answer_comments weibo_comments tieba_comments").split()
query("catalog_row_counts", duck(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM fx_{t} HAVING count(*) > 0"
    for t in TABLES) + """ UNION ALL SELECT 'keyword_posts', count(*) FROM fx_links
UNION ALL SELECT 'scrape_runs', count(*) FROM fx_runs
UNION ALL SELECT 'engagement_snapshots', count(*) FROM fx_snapshots"""))(
    lambda f: T.row_counts(f.tables))
EVOLVED = [fl.name for fl in SCHEMAS["bili_videos"].fields]
query("schema_evolve_union", duck("SELECT " + ", ".join(
    {"bvid": "bvid", "title": "title", "tags": "CAST(NULL AS VARCHAR) AS tags",
     "desc": 'CAST(NULL AS VARCHAR) AS "desc"', "raw": "CAST(NULL AS VARCHAR) AS raw",
     "owner_name": "CAST(NULL AS VARCHAR) AS owner_name", "aid": "aid"}.get(
        c, f'CAST(NULL AS BIGINT) AS "{c}"') for c in EVOLVED)
    + " FROM fx_bili_videos UNION ALL SELECT "
    + ", ".join(f'"{c}"' for c in EVOLVED) + " FROM fx_bili_videos"))(
    lambda f: G.evolve(f.fx_bili_videos.select("bvid", "title", "aid"), SCHEMAS["bili_videos"])
    .unionByName(G.evolve(f.fx_bili_videos, SCHEMAS["bili_videos"])))


@query("schema_generations", duck("""
SELECT bvid, title, "view", NULL::VARCHAR AS tags, 0::BIGINT AS generation FROM fx_bili_videos
UNION ALL SELECT bvid, NULL, "view", tags, 1 FROM fx_bili_videos
UNION ALL SELECT bvid, title, "view" + 5000000000, tags, 2 FROM fx_bili_videos"""))
def schema_generations(f):
    # Three generations of a table on disk: views grow from int to bigint, ids from whole numbers
    # to text, a column comes and another goes and comes back.
    root = scratch_path(f.spark, "generations")
    v = f.fx_bili_videos
    GN.write_generation(v.select(F.col("bvid").cast("bigint"), "title",
                                 F.col("view").cast("int")), root)
    GN.write_generation(v.select("bvid", "view", "tags"), root)
    GN.write_generation(v.select("tags", "bvid", "title",
                                 (F.col("view") + 5_000_000_000).alias("view")), root)
    return GN.read_generations(f.spark, root)


query("scan_filter", duck("""
SELECT * FROM fx_posts WHERE like_count > 500 AND (platform = 'bili' OR platform = 'weibo')"""))(
    lambda f: T.scan(f.fx_posts, "like_count > 500 AND (platform = 'bili' OR "
                                 "platform = 'weibo')"))
query("parse_raw_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")(
    lambda f: T.scan(f.events.select("event_id", F.col("props").alias("raw")), parse_raw=True)
    .select("event_id", F.try_variant_get("raw_parsed", "$.k", "bigint").alias("k")))
query("json_roundtrip_tags", """
SELECT doc_id, source AS first_tag, 2::INT AS n_tags FROM documents""")(
    lambda f: G.lists_to_json(f.documents.select("doc_id", F.array("source", "lang").alias("t")))
    .select("doc_id", F.from_json("t", "array<string>").alias("t"))
    .select("doc_id", F.col("t")[0].alias("first_tag"), F.size("t").alias("n_tags")))


def csv_roundtrip(f):
    path = scratch_path(f.spark, "csv")
    df = f.documents.select("doc_id", "text", "lang", "source", "n_chars")
    sinks.export_csv(df, path)
    return f.spark.read.schema(df.schema).options(header=True, escape='"', multiLine=True).csv(
        path)


query("export_csv_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")(
    csv_roundtrip)


def json_roundtrip(f):
    path = scratch_path(f.spark, "json")
    kept = {t: f.tables[t] for t in ("weibo_posts", "weibo_comments")}
    sinks.export_json(kept, path)
    back = [f.spark.read.schema(kept[t].schema).json(f"{path}/{t}").select(
        F.lit(t).alias("table_name"),
        F.col("id" if t == "weibo_posts" else "comment_id").alias("id"), "user_name", "text",
        "created_ts", "raw") for t in kept]
    return back[0].unionByName(back[1])


query("export_json_roundtrip", duck("""
SELECT 'weibo_posts' AS table_name, id, user_name, text, created_ts, raw FROM fx_weibo_posts
UNION ALL SELECT 'weibo_comments', comment_id, user_name, text, created_ts, raw
FROM fx_weibo_comments"""))(json_roundtrip)
query("export_json_rows")(
    lambda f: sinks.json_rows(f.stored("fx_base", "fx_comments").tables))


def export_run(f):
    path = scratch_path(f.spark, "run")
    paths = sinks.export_run(f.corpus, 199711, path, chinese=False)
    posts = f.spark.read.options(header=True, escape='"', multiLine=True).csv(paths["posts"])
    bom = posts.columns[0]
    return posts.withColumnRenamed(bom, bom.lstrip(sinks.BOM)).select(
        "platform", "post_id", "url", "title",
        F.col("comment_count").cast("bigint").alias("comment_count"))


def export_all(f, name, *columns):
    paths = sinks.export_all_runs(f.corpus, scratch_path(f.spark, "runs"), chinese=False,
                                  compression="gzip")
    rows = f.spark.read.options(header=True, escape='"', multiLine=True).csv(paths[name])
    rows = rows.select(*(F.col(f"`{c}`").alias(c.lstrip(sinks.BOM)) for c in rows.columns))
    return rows.select(F.col("run_id").cast("bigint").alias("run_id"), *columns)


def _all_runs_sql():
    from catalog.analytics import sql
    return sql("""
SELECT run_id, platform, post_id, url, title FROM (
  SELECT DISTINCT run_id, platform, post_id, url, title FROM linked UNION ALL
  SELECT a.run_id, platform, post_id, url, title FROM fx_posts
  JOIN (SELECT DISTINCT run_id, post_id FROM answer_ids) a USING (post_id)
  WHERE platform = 'zhihu_answer')
WHERE run_id IN (SELECT run_id FROM fx_runs)""", "pairs", "linked", "answer_ids")


query("export_all_runs", _all_runs_sql())(
    lambda f: export_all(f, "posts", "platform", "post_id", "url", "title"))


def _run_sql():
    from catalog.analytics import sql
    return sql("""
SELECT DISTINCT platform, post_id, url, title, comment_count FROM linked WHERE run_id = 199711
UNION ALL SELECT platform, post_id, url, title, comment_count FROM fx_posts
WHERE platform = 'zhihu_answer'
  AND post_id IN (SELECT post_id FROM answer_ids WHERE run_id = 199711)""",
               "pairs", "linked", "answer_ids")


query("export_run_posts", _run_sql())(export_run)
