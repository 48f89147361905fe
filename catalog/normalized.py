"""Payload normalization: payloads are built from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import duck
from catalog.registry import query
from catalog.writes import both
from hearsay.normalize import bili as B, common as C, responses as P, tieba as TB, weibo as WB
from hearsay.normalize import zhihu as Z
from hearsay.functions.scalars import utc_day
from hearsay.operators import chains as K
from hearsay.plans import linkage as LK
from hearsay.plans.ingest import normalize_batch
from hearsay.session import scratch_path

# ---- video platform ---------------------------------------------------------------------

VIDEO = """
SELECT aid, to_json(named_struct('code', 0, 'data', named_struct('bvid', bvid, 'aid', aid,
    'title', title, 'owner', named_struct('mid', owner_mid, 'name', owner_name),
    'pubdate', pubdate, 'stat', named_struct('view', view, 'like', like, 'coin', coin,
      'favorite', favorite, 'reply', reply, 'share', share, 'danmaku', danmaku)))) AS body,
  to_json(named_struct('data', array(named_struct('tag_name', tags),
    named_struct('tag_name', ''), named_struct('tag_name', owner_name)))) AS tag_body
FROM {v}"""


def _videos(f):
    payloads = f.spark.sql(VIDEO, v=f.fx_bili_videos)
    return payloads, B.norm_tags(payloads.select("aid", F.col("tag_body").alias("body")))


query("norm_video", duck("""
SELECT bvid, aid, title, '' AS "desc", owner_mid, owner_name, COALESCE(pubdate, 0) AS pubdate,
  0::BIGINT AS duration, "view", "like", coin, favorite, reply, share, danmaku,
  tags || '|' || owner_name AS tags FROM fx_bili_videos"""))(
    lambda f: B.norm_video(*_videos(f)).withColumn("tags", F.concat_ws("|", "tags")).drop("raw"))
query("norm_tags", duck(
    "SELECT aid, tags || '|' || owner_name AS tags FROM fx_bili_videos"))(
    lambda f: _videos(f)[1].withColumn("tags", F.concat_ws("|", "tags")))
query("video_snapshots", duck("""
SELECT 'bili' AS platform, bvid AS post_id, 1700000000::BIGINT AS fetched_at,
  "view" AS view_count, "like" AS like_count, reply AS comment_count,
  favorite AS favorite_count, share AS share_count FROM fx_bili_videos"""))(
    lambda f: B.snapshots(B.norm_video(_videos(f)[0]).withColumn(
        "fetched_at", F.lit(1700000000).cast("bigint"))))
# A reply page per order; an order has few lines.
REPLIES = """
SELECT l_orderkey AS oid, 1 AS page_no, to_json(named_struct('code', 0, 'data',
    named_struct('replies', collect_list(named_struct('rpid', l_partkey * 100 + l_linenumber,
      'mid', l_suppkey, 'member', named_struct('uname', l_returnflag),
      'content', named_struct('message', l_linestatus),
      'ctime', EPOCH(l_shipdate), 'like', CAST(l_quantity AS BIGINT)))))) AS body
FROM {lineitem} GROUP BY l_orderkey"""
query("norm_comments", """
SELECT l_partkey * 100 + l_linenumber AS rpid, l_orderkey AS oid, 0::BIGINT AS parent,
  l_suppkey AS mid, l_returnflag AS uname, l_linestatus AS message,
  CAST(epoch(l_shipdate) AS BIGINT) AS ctime, CAST(l_quantity AS BIGINT) AS likes
FROM lineitem""")(
    lambda f: B.norm_comments(both(f, REPLIES, lineitem=f.lineitem)).drop("raw"))
UPLOADS = """
SELECT CAST(c_nationkey AS BIGINT) AS mid, CAST(floor(c_custkey / 100) AS BIGINT) AS page_no,
  to_json(named_struct('data', named_struct('list', named_struct('vlist', array_sort(
    collect_list(named_struct('aid', c_custkey, 'bvid', c_name, 'title', c_mktsegment,
      'created', c_custkey, 'play', '--'))))))) AS body
FROM {customer} GROUP BY 1, 2"""
query("norm_user_videos", """
SELECT CAST(c_nationkey AS BIGINT) AS mid, CAST(floor(c_custkey / 100) AS BIGINT) AS page_no,
  row_number() OVER (PARTITION BY c_nationkey, floor(c_custkey / 100) ORDER BY c_custkey) - 1
    AS pos, c_name AS bvid, c_custkey AS aid, c_mktsegment AS title, c_custkey AS created,
  CAST(NULL AS BIGINT) AS play FROM customer""")(
    lambda f: B.norm_user_videos(f.spark.sql(UPLOADS, customer=f.customer)).drop("raw"))
FEED = """
SELECT to_json(named_struct('data', named_struct('items', collect_list(named_struct(
    'id_str', CASE WHEN event_type <> 'error' THEN CAST(event_id AS STRING) ELSE '' END,
    'id', event_id, 'type', event_type, 'modules', named_struct(
      'module_author', named_struct('mid', user_id, 'name', event_type, 'pub_ts', EPOCH(ts)),
      'module_dynamic', named_struct(
        'desc', CASE WHEN event_type = 'click' THEN named_struct('text', 'said') END,
        'major', named_struct('type', CASE WHEN event_type IN ('view', 'click')
            THEN 'MAJOR_TYPE_ARCHIVE' ELSE 'MAJOR_TYPE_DRAW' END,
          'archive', named_struct('bvid', concat('BV', CAST(event_id AS STRING)),
            'title', props))),
      'module_stat', named_struct('like', named_struct('count', user_id),
        'comment', named_struct('count', event_id)))))))) AS body
FROM {events} GROUP BY floor(event_id / 20)"""
query("norm_dynamics", """
SELECT CAST(event_id AS VARCHAR) AS dynamic_id, user_id AS mid, event_type AS uname,
  event_type AS type, CASE event_type WHEN 'click' THEN 'said' WHEN 'view' THEN props ELSE '' END
    AS text, CAST(floor(epoch(ts)) AS BIGINT) AS pub_ts, user_id AS like_count,
  event_id AS comment_count, CAST(NULL AS BIGINT) AS forward_count,
  CASE WHEN event_type IN ('view', 'click') THEN 'BV' || event_id END AS bvid FROM events""")(
    lambda f: B.norm_dynamics(both(f, FEED, events=f.events)).drop("raw"))
SEARCH = """
SELECT o_orderpriority AS keyword, CAST(floor(o_orderkey / 20) AS BIGINT) AS page_no,
  to_json(named_struct('code', 0, 'data', named_struct('result', array(
    named_struct('result_type', 'user', 'data', array(named_struct('pos', -1L,
      'bvid', 'user', 'title', '', 'author', '', 'play', ''))),
    named_struct('result_type', 'video', 'data', array_sort(collect_list(named_struct(
      'pos', o_orderkey, 'bvid', concat('BV', CAST(o_custkey AS STRING)),
      'title', concat('a <em class="keyword">', o_orderstatus, '</em> z'),
      'author', o_orderstatus, 'play', CAST(o_custkey AS STRING)))))))) ) AS body
FROM {orders} GROUP BY 1, 2"""
query("norm_search_rank", """
SELECT o_orderpriority AS keyword, 'BV' || o_custkey AS bvid,
  'a ' || o_orderstatus || ' z' AS title, o_orderstatus AS author, o_custkey AS play,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rank FROM orders""")(
    lambda f: B.norm_search(f.spark.sql(SEARCH, orders=f.orders)).drop("raw"))

# ---- question platform ------------------------------------------------------------------

QUESTION = """
SELECT id AS question_id, to_json(named_struct('id', id, 'title', title,
  'detail', concat('<p>', detail, '</p><p> ', title, ' &amp; more</p>'),
  'answer_count', answer_count, 'follower_count', follower_count, 'visit_count', view_count,
  'created', created, 'topics', array(named_struct('name', topics, 'title', NULL),
    named_struct('name', '', 'title', title), named_struct('name', NULL, 'title', NULL))))
  AS body FROM {q}"""
query("norm_question", duck("""
SELECT id, title, detail || chr(10) || title || ' & more' AS detail, answer_count,
  follower_count, view_count, created, topics || '|' || title AS topics
FROM fx_zhihu_questions"""))(
    lambda f: Z.norm_question(f.spark.sql(QUESTION, q=f.fx_zhihu_questions))
    .withColumn("topics", F.concat_ws("|", "topics")).drop("raw"))
ANSWERS = """
SELECT question_id, to_json(named_struct('data', array(named_struct('id', id,
  'author', named_struct('id', author_id, 'name', author_name), 'voteup_count', voteup_count,
  'comment_count', comment_count, 'created_time', created_time, 'updated_time', updated_time,
  'content', concat('<p>', content, '</p>'))))) AS body FROM {a}"""
query("norm_answers", duck("""
SELECT id, question_id, author_id, author_name, voteup_count, comment_count, created_time,
  updated_time, content FROM fx_zhihu_answers"""))(
    lambda f: Z.norm_answers(f.spark.sql(ANSWERS, a=f.fx_zhihu_answers)).drop("raw"))
GENERAL = """
SELECT o_orderpriority AS keyword, CAST(floor(o_orderkey / 20) AS BIGINT) AS page_no,
  to_json(named_struct('data', array_sort(collect_list(named_struct('at', o_orderkey,
    'type', 'hit', 'id', CAST(o_orderkey AS STRING),
    'object', CASE o_orderstatus
      WHEN 'F' THEN named_struct('type', 'question', 'id', CAST(o_custkey AS STRING),
        'title', o_orderpriority, 'name', NULL, 'excerpt', NULL, 'excerpt_new', '<b>new</b>',
        'question', named_struct('id', NULL, 'title', NULL))
      WHEN 'O' THEN named_struct('type', 'answer', 'id', CAST(o_custkey AS STRING),
        'title', NULL, 'name', NULL, 'excerpt', 'old', 'excerpt_new', 'new',
        'question', named_struct('id', o_custkey, 'title', 'parent'))
      ELSE named_struct('type', NULL, 'id', NULL, 'title', NULL, 'name', 'someone',
        'excerpt', NULL, 'excerpt_new', NULL,
        'question', named_struct('id', NULL, 'title', NULL)) END))))) AS body
FROM {orders} GROUP BY 1, 2"""
query("norm_general_search", """
SELECT o_orderpriority AS keyword, CAST(floor(o_orderkey / 20) AS BIGINT) AS page_no,
  row_number() OVER (PARTITION BY o_orderpriority, floor(o_orderkey / 20)
    ORDER BY o_orderkey) - 1 AS pos,
  CASE o_orderstatus WHEN 'F' THEN 'question' WHEN 'O' THEN 'answer' ELSE 'hit' END AS kind,
  CAST(CASE WHEN o_orderstatus IN ('F', 'O') THEN o_custkey ELSE o_orderkey END AS VARCHAR)
    AS target_id,
  CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN 'parent' ELSE 'someone' END
    AS title,
  CASE o_orderstatus WHEN 'F' THEN 'new' WHEN 'O' THEN 'old' ELSE '' END AS excerpt,
  CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS VARCHAR) END AS parent_id
FROM orders""")(
    lambda f: Z.norm_general_search(f.spark.sql(GENERAL, orders=f.orders)).drop("raw"))
ARTICLE = """
SELECT source AS column_id, to_json(named_struct('data', collect_list(named_struct(
  'id', doc_id, 'title', lang, 'author', named_struct('id', source, 'name', lang),
  'column', named_struct('id', 'own'), 'voteup_count', n_chars, 'comment_count', doc_id,
  'created', doc_id, 'excerpt', '<b>x</b>', 'content', text)))) AS body
FROM {documents} GROUP BY source, floor(doc_id / 400)"""
ARTICLE_SQL = """
SELECT doc_id AS id, {} AS column_id, lang AS title, source AS author_id, lang AS author_name,
  n_chars AS voteup_count, doc_id AS comment_count, doc_id AS created,
  CAST(NULL AS BIGINT) AS updated, 'x' AS excerpt, text AS content FROM documents"""
query("norm_column_items", ARTICLE_SQL.format("source"))(
    lambda f: Z.norm_column_items(f.spark.sql(ARTICLE, documents=f.documents)).drop("raw"))
SINGLE = """
SELECT to_json(named_struct('id', doc_id, 'title', lang, 'author', named_struct('id', source,
  'name', lang), 'column', named_struct('id', 'own'), 'voteup_count', n_chars,
  'comment_count', doc_id, 'created', doc_id, 'excerpt', '<b>x</b>', 'content', text)) AS body
FROM {documents}"""
query("norm_article", ARTICLE_SQL.format("'own'"))(
    lambda f: Z.norm_article(f.spark.sql(SINGLE, documents=f.documents)).drop("raw"))
COLUMN = """
SELECT CAST(c_custkey AS STRING) AS column_id, to_json(named_struct('title', c_name,
  'author', named_struct('id', CAST(c_nationkey AS STRING), 'name', c_mktsegment),
  'description', concat('<p>', c_mktsegment, '</p>'), 'articles_count', c_nationkey,
  'followers', c_custkey, 'created', c_custkey)) AS body FROM {customer}"""
query("norm_column", """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, CAST(c_nationkey AS VARCHAR)
    AS author_id, c_mktsegment AS author_name, c_mktsegment AS description,
  CAST(c_nationkey AS BIGINT) AS articles_count, c_custkey AS followers, c_custkey AS created,
  CAST(NULL AS BIGINT) AS updated FROM customer""")(
    lambda f: Z.norm_column(f.spark.sql(COLUMN, customer=f.customer)).drop("raw"))
# A rendered page per order, whose lines are the answers; returned lines belong elsewhere.
STATE = """
SELECT question_id, concat('<html><head><script id="js-initialData" type="text/json">',
  to_json(named_struct('initialState', named_struct('entities', named_struct(
    'questions', map(CAST(question_id AS STRING), named_struct('id', question_id,
      'title', concat('q', CAST(question_id AS STRING)), 'detail', '<p>d</p>',
      'answerCount', n, 'visit_count', n + 1, 'topicIds', array('t1', 't2', 't3'))),
    'topics', map('t1', named_struct('name', 'one'), 't2', named_struct('name', '')),
    'answers', map_from_entries(transform(answers, (x, i) ->
      struct(concat(x.k, '-', CAST(i AS STRING)), x.v))))))), '</script></head><body></body></html>') AS html
FROM (SELECT l_orderkey AS question_id, count(*) AS n, array_sort(collect_list(struct(
    CAST((l_partkey * 10000000 + l_suppkey) * 100 + l_linenumber AS STRING) AS k,
    named_struct('id', (l_partkey * 10000000 + l_suppkey) * 100 + l_linenumber,
      'question', named_struct('id', CASE WHEN l_returnflag = 'R' THEN l_orderkey + 1
        ELSE l_orderkey END),
      'author', named_struct('id', CAST(l_suppkey AS STRING), 'name', l_returnflag),
      'voteupCount', CAST(l_quantity AS BIGINT), 'comment_count', l_linenumber,
      'createdTime', EPOCH(l_shipdate), 'content', concat('<p>', l_linestatus, '</p>')) AS v)))
    AS answers
  FROM {lineitem} GROUP BY l_orderkey)"""
EMBEDDED = """
SELECT id, question_id, author_id, author_name, voteup_count, comment_count, created_time,
  CAST(NULL AS BIGINT) AS updated_time, content FROM (
  SELECT (l_partkey * 10000000 + l_suppkey) * 100 + l_linenumber AS id,
    l_orderkey AS question_id, CAST(l_suppkey AS VARCHAR) AS author_id,
    l_returnflag AS author_name, CAST(l_quantity AS BIGINT) AS voteup_count,
    CAST(l_linenumber AS BIGINT) AS comment_count, CAST(epoch(l_shipdate) AS BIGINT)
      AS created_time, l_linestatus AS content,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, CAST(
      (l_partkey * 10000000 + l_suppkey) * 100 + l_linenumber AS VARCHAR),
      l_returnflag, l_shipdate, l_linestatus) AS r
  FROM lineitem WHERE l_returnflag <> 'R')"""
query("norm_embedded_state", EMBEDDED)(
    lambda f: Z.embedded_answers(both(f, STATE, lineitem=f.lineitem)).drop("raw"))
query("norm_embedded_state_capped", EMBEDDED + " WHERE r <= 3")(
    lambda f: Z.embedded_answers(both(f, STATE, lineitem=f.lineitem), 3).drop("raw"))
query("norm_embedded_questions", """
SELECT l_orderkey AS id, 'q' || l_orderkey AS title, 'd' AS detail, count(*) AS answer_count,
  CAST(NULL AS BIGINT) AS follower_count, count(*) + 1 AS view_count,
  CAST(NULL AS BIGINT) AS created, 'one|t2|t3' AS topics FROM lineitem GROUP BY l_orderkey""")(
    lambda f: Z.embedded_questions(both(f, STATE, lineitem=f.lineitem))
    .withColumn("topics", F.concat_ws("|", "topics")).drop("raw"))
COMMENTS = """
SELECT conv_id AS answer_id, to_json(named_struct('data', array_sort(collect_list(named_struct(
  'at', turn, 'id', conv_id * 100 + turn, 'author', named_struct('id', role, 'name', role),
  'content', text, 'vote_count', turn, 'created_time', conv_id))))) AS body
FROM {conversations} GROUP BY conv_id"""
ANSWER_COMMENTS = """
SELECT conv_id * 100 + turn AS comment_id, conv_id AS answer_id, role AS author_id,
  role AS author_name, text AS content, turn AS like_count, conv_id AS created_time
FROM conversations"""
query("norm_answer_comments", ANSWER_COMMENTS)(
    lambda f: Z.norm_answer_comments(
        f.spark.sql(COMMENTS, conversations=f.conversations)).drop("raw"))
query("norm_answer_comments_capped", ANSWER_COMMENTS + """
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3""")(
    lambda f: Z.norm_answer_comments(
        f.spark.sql(COMMENTS, conversations=f.conversations), 3).drop("raw"))

# ---- micropost platform -----------------------------------------------------------------

MBLOG = """named_struct('id', {id}, 'bid', 'b', 'user', named_struct('id', l_suppkey,
  'screen_name', l_returnflag), 'text', concat('<a>', l_linestatus, '</a> said'),
  'created_at', '5分钟前', 'comments_count', CAST(l_linenumber AS STRING),
  'attitudes_count', CAST(l_quantity AS BIGINT), 'reposts_count', '1.2万', 'isLongText', false)"""
_ID = "(l_partkey * 10000000 + l_suppkey) * 100 + l_linenumber"
CARD = f"""named_struct('at', {_ID},
    'card_type', CASE WHEN l_returnflag = 'N' THEN 11 ELSE 9 END,
    'mblog', CASE WHEN l_returnflag <> 'N' THEN {MBLOG.format(id=_ID)} END,
    'card_group', CASE WHEN l_returnflag <> 'A' THEN array(
      named_struct('card_type', 9, 'mblog', {MBLOG.format(id='-(' + _ID + ')')}),
      named_struct('card_type', 8, 'mblog', {MBLOG.format(id='1')})) END)"""
# A page per order: flat cards, groups without a post of their own, and cards with both. The narrow
# lines are collected, not the cards.
CARDS = f"""
SELECT CAST(l_orderkey AS STRING) AS keyword, 1 AS page_no, to_json(named_struct('ok', 1,
  'data', named_struct('cards', array_sort(transform(lines, l -> {CARD.replace('l_', 'l.l_')})))))
  AS body
FROM (SELECT l_orderkey, collect_list(struct(l_partkey, l_suppkey, l_linenumber, l_quantity,
    l_returnflag, l_linestatus)) AS lines FROM {{lineitem}} GROUP BY l_orderkey)"""
CARD_IDS = f"""
SELECT *, {_ID} AS id FROM lineitem WHERE l_returnflag <> 'N'
UNION ALL SELECT *, -({_ID}) FROM lineitem WHERE l_returnflag <> 'A'"""
query("norm_cards", duck("""
SELECT CAST(l_orderkey AS VARCHAR) AS keyword, CAST(id AS VARCHAR) AS id FROM ids""",
    ids=CARD_IDS))(
    lambda f: WB.norm_cards(f.spark.sql(CARDS, lineitem=f.lineitem)).select(
        "keyword", C.get("mblog", "id").alias("id")))
query("norm_micropost", duck("""
SELECT CAST(id AS VARCHAR) AS id, 'b' AS mblogid, CAST(l_suppkey AS VARCHAR) AS user_id,
  l_returnflag AS user_name, l_linestatus || ' said' AS text, '5分钟前' AS created_at,
  1717999700::BIGINT AS created_ts, '' AS source, 0::BIGINT AS reposts_count,
  CAST(l_linenumber AS BIGINT) AS comments_count, CAST(l_quantity AS BIGINT) AS attitudes_count,
  false AS is_long FROM ids""", ids=CARD_IDS))(
    lambda f: WB.norm_micropost(
        WB.norm_cards(f.spark.sql(CARDS, lineitem=f.lineitem)), 1718000000).drop("raw"))
LONG = """
SELECT CAST(doc_id AS STRING) AS id, substring(text, 1, 40) AS text, n_chars > 1000 AS is_long
FROM {documents}"""
EXTENDED = """
SELECT CAST(doc_id AS STRING) AS id, to_json(named_struct('data', named_struct(
  'longTextContent', CASE WHEN lang <> 'de' THEN text ELSE '' END))) AS body FROM {documents}"""
query("long_text_override", """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN n_chars > 1000 AND lang <> 'de' THEN text
  ELSE substring(text, 1, 40) END AS text, n_chars > 1000 AS is_long FROM documents""")(
    lambda f: WB.long_text_override(f.spark.sql(LONG, documents=f.documents),
                                    f.spark.sql(EXTENDED, documents=f.documents)))
HOTFLOW = """
SELECT CAST(conv_id AS STRING) AS post_id, CAST(floor(turn / 2) AS BIGINT) AS page_no,
  to_json(named_struct('ok', 1, 'data', named_struct('data', array_sort(collect_list(
    named_struct('id', conv_id * 100 + turn, 'user', named_struct('id', turn,
      'screen_name', role), 'text', text, 'created_at', '2024-01-02', 'like_count', turn))))))
  AS body FROM {conversations} GROUP BY 1, 2"""
HOTFLOW_ROWS = """
SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS comment_id, CAST(conv_id AS VARCHAR) AS post_id,
  CASE turn WHEN 0 THEN '0' ELSE CAST(turn AS VARCHAR) END AS user_id, role AS user_name, text,
  turn AS like_count, '2024-01-02' AS created_at, 1704153600::BIGINT AS created_ts
FROM conversations"""
query("norm_hotflow", HOTFLOW_ROWS)(
    lambda f: WB.norm_hotflow(f.spark.sql(HOTFLOW, conversations=f.conversations),
                              1718000000).drop("raw"))
query("norm_hotflow_capped", HOTFLOW_ROWS + """
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3""")(
    lambda f: WB.norm_hotflow(f.spark.sql(HOTFLOW, conversations=f.conversations),
                              1718000000, 3).drop("raw"))

# ---- forum platform ---------------------------------------------------------------------

FORUM = """
SELECT o_orderpriority AS keyword, CAST(floor(o_orderkey / 20) AS BIGINT) AS page_no,
  to_json(named_struct('errno', 0, 'data', named_struct('forum', named_struct('name', ''),
    'thread_list', array_sort(collect_list(named_struct('at', o_orderkey, 'tid', o_custkey,
      'title', concat('t', CAST(o_orderkey AS STRING)), 'abstract', o_orderstatus,
      'is_top', CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END,
      'author', named_struct('name', '', 'name_show', 'shown', 'id', o_custkey),
      'reply_num', CAST(o_orderkey AS STRING), 'create_time', 0)))))) AS body
FROM {orders} GROUP BY 1, 2"""
query("norm_forum_feed", """
SELECT o_orderpriority AS keyword, CAST(o_custkey AS VARCHAR) AS tid, 't' || o_orderkey AS title,
  o_orderstatus AS excerpt, o_orderpriority AS forum_name, 'shown' AS author_name,
  CAST(o_custkey AS VARCHAR) AS author_id, o_orderkey AS reply_num, '' AS created_at,
  CAST(NULL AS BIGINT) AS created_ts
FROM orders WHERE o_orderstatus <> 'P'
QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) = 1""")(
    lambda f: TB.norm_forum_feed(f.spark.sql(FORUM, orders=f.orders)).drop("page_no", "pos"))
THREADS = """
SELECT CAST(conv_id AS STRING) AS tid, to_json(named_struct('errno', CASE WHEN min(turn) > 0
    THEN 1 ELSE 0 END, 'data', named_struct('thread', named_struct('title', ''),
    'forum', named_struct('name', 'forum'), 'post_list', array_sort(collect_list(named_struct(
      'floor', turn + 1, 'id', CAST(conv_id * 100 + turn AS STRING), 'title', role,
      'author', named_struct('name_show', role, 'portrait', 'p'),
      'content', array(named_struct('type', 0, 'text', role),
        named_struct('type', 1, 'text', concat(text, '<br/>'))), 'time', turn)))))) AS body
FROM {conversations} GROUP BY conv_id"""
HIT = """
SELECT CAST(doc_id AS STRING) AS tid, lang AS title, 'seen' AS excerpt, source AS forum_name,
  lang AS author_name, source AS author_id, n_chars AS reply_num, '' AS created_at,
  doc_id + 1 AS created_ts FROM {documents}"""
FLOORS = """
SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS pid, CAST(conv_id AS VARCHAR) AS tid,
  turn + 1 AS floor, role AS author_name, 'p' AS author_id, trim(role || ' ' || text) AS content,
  '' AS created_at, nullif(turn, 0) AS created_ts FROM conversations
"""
query("norm_floors", FLOORS + " QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) >= 2")(
    lambda f: TB.norm_floors(
        f.spark.sql(THREADS, conversations=f.conversations)).drop("raw"))
query("norm_floors_capped", FLOORS + """
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) BETWEEN 2 AND 4""")(
    lambda f: TB.norm_floors(
        f.spark.sql(THREADS, conversations=f.conversations), 3).drop("raw"))
query("norm_thread", """
SELECT CAST(doc_id AS VARCHAR) AS tid, COALESCE(c.role, lang) AS title,
  COALESCE(c.role, lang) AS author_name, CASE WHEN c.role IS NULL THEN source ELSE 'p' END
    AS author_id, CASE WHEN c.role IS NULL THEN source ELSE 'forum' END AS forum_name,
  COALESCE(trim(c.role || ' ' || c.text), 'seen') AS content, n_chars AS reply_num,
  '' AS created_at, doc_id + 1 AS created_ts, 'https://tieba.baidu.com/p/' || doc_id AS url
FROM documents LEFT JOIN conversations c ON c.conv_id = doc_id AND c.turn = 0""")(
    lambda f: TB.norm_thread(f.spark.sql(HIT, documents=f.documents),
                             f.spark.sql(THREADS, conversations=f.conversations)).drop("raw"))
SEGMENTS = """
SELECT doc_id, to_json(array(named_struct('type', 0, 'text', source),
  named_struct('type', 2, 'text', ''), named_struct('type', 1, 'text', concat(text, '<br/>'))))
  AS body FROM {documents}"""
query("segments_to_text", r"""
SELECT doc_id, regexp_replace(source || ' ' || text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS text
FROM documents""")(
    lambda f: f.spark.sql(SEGMENTS, documents=f.documents).select(
        "doc_id", TB.segments_to_text(F.try_parse_json("body")).alias("text")))
query("html_extract_links", """
SELECT page_id, tid, arg_min(title, pos) AS title FROM (
  SELECT page_id, unnest(tids) AS tid, unnest(titles) AS title, generate_subscripts(tids, 1)
    AS pos FROM (SELECT page_id,
      regexp_extract_all(html, '<a href="/([^"]+)">([^<]+)</a>', 1) AS tids,
      regexp_extract_all(html, '<a href="/([^"]+)">([^<]+)</a>', 2) AS titles FROM pages))
GROUP BY 1, 2""")(
    lambda f: TB.html_extract_links(f.pages, "page_id", "html", r"/([^\"'/?#]+)")
    .select("page_id", "tid", "title"))
RESULT_PAGE = """
SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS page_id, concat('<html><body>', concat_ws('',
  transform(array_sort(collect_list(struct(c_custkey, c_name, c_mktsegment, c_nationkey))), x ->
    concat('<div class="a s_post b"><span class="p_title"><a class="bluelink" href="/p/',
      CAST(x.c_custkey AS STRING), '?pid=1">', x.c_name, ' &amp; <em>co</em></a></span>',
      '<div class="p_content">', x.c_mktsegment, ' <b>x</b></div>',
      '<a href="/f?kw=k" class="p_forum">', x.c_mktsegment, '</a>',
      '<a href="/home/main?un=u">n', CAST(x.c_nationkey AS STRING), '</a>',
      '<font class="p_green p_date">2024-01-01</font></div>'))), '</body></html>') AS html
FROM {customer} GROUP BY 1"""
query("parse_search_html", """
SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS page_id, CAST(c_custkey AS VARCHAR) AS tid,
  c_name || ' &co' AS title, c_mktsegment || ' x' AS excerpt, c_mktsegment AS forum_name,
  'n' || c_nationkey AS author_name, '2024-01-01' AS created_at FROM customer""")(
    lambda f: TB.parse_search_html(f.spark.sql(RESULT_PAGE, customer=f.customer)).drop("pos"))

# The same hits with nested markup, image links, open tags, comments and quoted brackets.
NESTED_PAGE = """
SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS page_id, concat('<html><body><ul>', concat_ws('',
  transform(array_sort(collect_list(struct(c_custkey, c_name, c_mktsegment, c_nationkey))), x ->
    concat('<li><!-- <a href="/p/0">no</a> --><div title="a > b" class="s_post"><a href="/p/',
      CAST(x.c_custkey AS STRING), '"><img src="i.png"></a><h3 class="p_title"><b><A HREF="/p/',
      CAST(x.c_custkey AS STRING), '?pid=1"><img alt="x"/><span>', x.c_name,
      '</span><i> <b>&lt;co&gt;</b></i></A></b></h3>',
      '<div class="x p_content"><div><div>', x.c_mktsegment, '</div></div><script>"</div>"',
      '</script> <p>in <b>bold</b></div><p class="p_date">2024-01-', CAST(1 + x.c_nationkey AS
      STRING), '<a class="p_author" href="u"><span>n', CAST(x.c_nationkey AS STRING),
      '</span></a></p></div>'))), '</ul></body></html>') AS html
FROM {customer} GROUP BY 1"""
query("parse_search_html_nested", """
SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS page_id, CAST(c_custkey AS VARCHAR) AS tid,
  c_name || '<co>' AS title, c_mktsegment || ' in bold' AS excerpt, '' AS forum_name,
  'n' || c_nationkey AS author_name, '2024-01-' || (1 + c_nationkey) || 'n' || c_nationkey
    AS created_at FROM customer""")(
    lambda f: TB.parse_search_html(f.spark.sql(NESTED_PAGE, customer=f.customer)).drop("pos"))

# ---- pages and responses ----------------------------------------------------------------

query("pages_until_empty", """
SELECT o_custkey, o_orderkey AS page_no, o_orderstatus FROM (
  SELECT *, min(CASE o_orderstatus WHEN 'P' THEN o_orderkey - 1 WHEN 'F' THEN o_orderkey END)
    OVER (PARTITION BY o_custkey) AS last FROM orders)
WHERE last IS NULL OR o_orderkey <= last""")(
    lambda f: C.pages_until_empty(
        f.orders.select("o_custkey", F.col("o_orderkey").alias("page_no"), "o_orderstatus"),
        ["o_custkey"], F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "F"))
# A user's events are pages, linked by cursors only: some say they are the last, some are empty,
# and some name a page that never landed.
CHAIN = """
SELECT user_id, event_id, CASE WHEN lag(event_id) OVER w IS NULL THEN '' ELSE
    concat('c', CAST(event_id AS STRING)) END AS cursor,
  CASE WHEN event_id % 17 = 0 THEN concat('lost', CAST(event_id AS STRING))
    ELSE concat('c', CAST(lead(event_id) OVER w AS STRING)) END AS next_cursor,
  event_id % 23 = 0 AS ended, event_id % 19 = 0 AS is_empty
FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""
CHAIN_DUCK = (CHAIN.replace("AS STRING", "AS VARCHAR").replace("{events}", "events")
              .replace("concat('c', CAST(lead(event_id) OVER w AS VARCHAR))",
                       "'c' || lead(event_id) OVER w"))


@query("pages_by_cursor", f"""
WITH RECURSIVE linked AS ({CHAIN_DUCK}), walk AS (
  SELECT user_id, event_id, CASE WHEN NOT ended THEN next_cursor END AS next_cursor,
    1 AS page_no FROM linked WHERE cursor = '' AND NOT is_empty
  UNION ALL
  SELECT l.user_id, l.event_id, CASE WHEN NOT l.ended THEN l.next_cursor END, page_no + 1
  FROM walk JOIN linked l ON l.user_id = walk.user_id AND l.cursor = walk.next_cursor
  WHERE NOT l.is_empty)
SELECT user_id, event_id, page_no FROM walk""")
def pages_by_cursor(f):
    pages = f.spark.sql(CHAIN, events=f.events)
    kept = K.pages_by_cursor(pages, ["user_id"], "cursor", F.col("next_cursor"),
                             F.col("is_empty"), F.col("ended"))
    return kept.select("user_id", "event_id", "page_no")


# The same rows as feeds and comment pages, with the cursors in their bodies.
FEED_PAGES = """
SELECT user_id AS mid, nullif(cursor, '') AS cursor, to_json(named_struct('data', named_struct(
  'has_more', NOT ended, 'offset', next_cursor, 'items', CASE WHEN is_empty THEN array()
    ELSE array(named_struct('id_str', CAST(event_id AS STRING))) END))) AS body FROM {chain}"""


@query("norm_dynamics_by_cursor", f"""
WITH RECURSIVE linked AS ({CHAIN_DUCK}), walk AS (
  SELECT user_id, event_id, CASE WHEN NOT ended THEN next_cursor END AS next_cursor
  FROM linked WHERE cursor = '' AND NOT is_empty
  UNION ALL
  SELECT l.user_id, l.event_id, CASE WHEN NOT l.ended THEN l.next_cursor END
  FROM walk JOIN linked l ON l.user_id = walk.user_id AND l.cursor = walk.next_cursor
  WHERE NOT l.is_empty)
SELECT CAST(event_id AS VARCHAR) AS dynamic_id FROM walk""")
def norm_dynamics_by_cursor(f):
    pages = f.spark.sql(FEED_PAGES, chain=f.spark.sql(CHAIN, events=f.events))
    return B.norm_dynamics(B.feed_pages(pages)).select("dynamic_id")


HOTFLOW_CHAIN = """
SELECT CAST(conv_id AS STRING) AS post_id,
  CASE WHEN turn > 0 THEN CAST(turn AS STRING) END AS cursor,
  to_json(named_struct('ok', CASE WHEN conv_id % 7 = 0 AND turn = 3 THEN 0 ELSE 1 END,
    'data', named_struct('max_id', CASE WHEN role = 'system' THEN 0 ELSE turn + 1 END,
      'data', array(named_struct('id', conv_id * 100 + turn, 'user', named_struct('id', turn,
        'screen_name', role), 'text', text, 'created_at', '2024-01-02', 'like_count', turn)))))
  AS body FROM {conversations}"""


@query("norm_hotflow_by_cursor", """
WITH RECURSIVE pages_ AS (
  SELECT *, conv_id % 7 = 0 AND turn = 3 AS blocked FROM conversations),
walk AS (
  SELECT conv_id, turn, role, text FROM pages_ WHERE turn = 0 AND NOT blocked
  UNION ALL
  SELECT p.conv_id, p.turn, p.role, p.text FROM walk JOIN pages_ p
  ON p.conv_id = walk.conv_id AND p.turn = walk.turn + 1
  WHERE walk.role <> 'system' AND NOT p.blocked)
SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS comment_id, CAST(conv_id AS VARCHAR) AS post_id,
  CASE turn WHEN 0 THEN '0' ELSE CAST(turn AS VARCHAR) END AS user_id, role AS user_name, text,
  turn AS like_count, '2024-01-02' AS created_at, 1704153600::BIGINT AS created_ts
FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 4""")
def norm_hotflow_by_cursor(f):
    pages = f.spark.sql(HOTFLOW_CHAIN, conversations=f.conversations)
    return WB.norm_hotflow(WB.hotflow_pages(pages), 1718000000, 4).drop("raw")


# Every order is a response; its key chooses platform, endpoint, status and body.
_CASES = [
    ("bili", "video", 200, '{"code": 0}', "OK"),
    ("bili", "video", 200, '{"code": -404}', "NotFound"),
    ("bili", "video", 200, '{"code": -101}', "AuthRequired"),
    ("bili", "video", 200, '{"code": -352}', "SoftBanned"),
    ("bili", "video", 200, '{"code": 7}', "OtherError"),
    ("bili", "search", 200, '{"code": 0, "data": {"result": []}}', "SoftBanned"),
    ("bili", "video", 412, "x", "RateLimited"),
    ("bili", "video", 502, "x", "OtherError"),
    ("zhihu", "question", 403, '{"error": {"code": 10003}}', "SoftBanned"),
    ("zhihu", "question", 401, '{"error": {"code": 100}}', "CookieExpired"),
    ("zhihu", "question", 403, '{"error": {}}', "AuthRequired"),
    ("zhihu", "question", 404, "{}", "NotFound"),
    ("zhihu", "search", 200, '{"data": []}', "SoftBanned"),
    ("zhihu", "page", 200, "<html></html>", "ParseError"),
    ("weibo", "comments", 418, "x", "SoftBanned"),
    ("weibo", "search", 200, '{"ok": -100}', "AuthRequired"),
    ("weibo", "search", 200, '{"ok": 1}', "SoftBanned"),
    ("weibo", "status", 200, '{"ok": 0}', "NotFound"),
    ("tieba", "thread", 200, '{"errno": 4}', "ParseError"),
    ("tieba", "thread", 200, "<html>", "ParseError"),
    ("tieba", "html_search", 403, "x", "SoftBanned"),
    ("tieba", "thread", 200, '{"errno": 0}', "OK"),
]


def _pick(i: int) -> str:
    values = [repr(c[i]) if isinstance(c[i], str) else str(c[i]) for c in _CASES]
    return f"CASE o_orderkey % {len(_CASES)} " + " ".join(
        f"WHEN {n} THEN {v}" for n, v in enumerate(values)) + " END"


query("response_classes", f"""
SELECT {_pick(0)} AS platform, {_pick(1)} AS endpoint, {_pick(4)} AS outcome, count(*) AS n
FROM orders GROUP BY 1, 2, 3""")(
    lambda f: P.response_classes(f.orders.selectExpr(
        f"{_pick(0)} AS platform", f"{_pick(1)} AS endpoint", "1 AS page_no",
        f"{_pick(2)} AS status", "false AS has_cookie", f"{_pick(3)} AS body")))

# ---- a whole batch: search pages, videos, their comments and forum feeds ----------------------

BATCH = f"""
SELECT 'bili' AS platform, 'search' AS endpoint, '' AS request_id, keyword, page_no + 1 AS page_no,
  body FROM ({SEARCH})
UNION ALL
SELECT 'tieba', 'forum', '', keyword, page_no + 1, body FROM ({FORUM})
UNION ALL
SELECT 'bili', 'video', '', '', 1L, to_json(named_struct('code', 0, 'data', named_struct(
  'bvid', concat('BV', CAST(c_custkey AS STRING)), 'aid', c_custkey, 'title', c_name,
  'pubdate', 1700000000L + c_nationkey * 86400, 'stat', named_struct('view', c_custkey))))
FROM {{customer}} WHERE c_custkey % 3 > 0
UNION ALL
SELECT 'bili', 'comments', CAST(o_custkey AS STRING), '', 1L, to_json(named_struct('code', 0,
  'data', named_struct('replies', collect_list(named_struct('rpid', o_orderkey)))))
FROM {{orders}} GROUP BY o_custkey
UNION ALL
SELECT 'weibo', 'search', '', 'blocked', 1L, '{{{{"ok": 1}}}}'"""
BATCH_AT, BATCH_COUNT = 1718000000, 200
HITS = f"""
WITH hits AS (
  SELECT o_orderpriority AS keyword, 'bili' AS platform, 'BV' || o_custkey AS post_id,
    o_orderkey AS k FROM orders
  UNION ALL
  SELECT o_orderpriority, 'tieba', CAST(o_custkey AS VARCHAR), o_orderkey FROM orders
  WHERE o_orderstatus <> 'P'),
firsts AS (SELECT keyword, platform, post_id, min(k) AS k FROM hits GROUP BY 1, 2, 3),
links AS (
  SELECT keyword, platform, post_id,
    row_number() OVER (PARTITION BY keyword, platform ORDER BY k) AS rank FROM firsts
  QUALIFY rank <= {BATCH_COUNT})
"""


def _batch(f):
    rows = f.spark.sql(BATCH, orders=f.orders, customer=f.customer).withColumns({
        "status": F.lit(200), "has_cookie": F.lit(True)})
    return LK.land(rows, scratch_path(f.spark, "landed"))


def _linked(f, payloads):
    none = f.spark.createDataFrame([], "keyword string, platform string, post_id string")
    return LK.ingest_links(payloads, none, BATCH_AT, BATCH_COUNT)


query("ingest_links", HITS + f"""
SELECT keyword, platform, post_id, rank, {BATCH_AT}::BIGINT AS fetched_at FROM links""")(
    lambda f: _linked(f, _batch(f)).drop("run_id"))


@query("ingest_runs", HITS + f""", asked AS (
  SELECT DISTINCT o_orderpriority AS keyword, platform
  FROM orders, (VALUES ('bili'), ('tieba')) p(platform)
  UNION ALL SELECT 'blocked', 'weibo'),
videos AS (SELECT 'BV' || c_custkey AS post_id, c_custkey FROM customer WHERE c_custkey % 3 > 0),
notes AS (SELECT post_id, count(*) AS n FROM orders JOIN videos ON c_custkey = o_custkey GROUP BY 1),
counted AS (
  SELECT keyword, platform, count(*) FILTER (platform = 'tieba' OR v.post_id IS NOT NULL) AS posts,
    sum(n) AS comments FROM links LEFT JOIN videos v USING (post_id) LEFT JOIN notes USING (post_id)
  GROUP BY 1, 2)
SELECT keyword, platform, {BATCH_COUNT}::BIGINT AS requested_count, {BATCH_AT}::BIGINT AS started_at,
  {BATCH_AT}::BIGINT AS finished_at, COALESCE(posts, 0) AS posts_fetched,
  CAST(COALESCE(comments, 0) AS BIGINT) AS comments_fetched,
  CASE keyword WHEN 'blocked' THEN 'SoftBanned' END AS error
FROM asked LEFT JOIN counted USING (keyword, platform)""")
def ingest_runs(f):
    payloads = _batch(f)
    runs = LK.ingest_runs(payloads, BATCH_AT, BATCH_COUNT)
    done = LK.close_ingested(runs, payloads, _linked(f, payloads),
                             normalize_batch(payloads, BATCH_AT), BATCH_AT)
    return done.drop("run_id", "config")


@query("ingest_volume_by_day", HITS + """
SELECT keyword, strftime(to_timestamp(1700000000 + c_nationkey * 86400) AT TIME ZONE 'UTC',
  '%Y-%m-%d') AS day, count(*) AS n_posts, sum(c_custkey)::BIGINT AS total_views
FROM links JOIN customer ON post_id = 'BV' || c_custkey
WHERE c_custkey % 3 > 0 GROUP BY 1, 2""")
def ingest_volume_by_day(f):
    # A keyword query straight over what was ingested.
    payloads = _batch(f)
    videos = normalize_batch(payloads, BATCH_AT)["bili_videos"]
    posts = _linked(f, payloads).where("platform = 'bili'").join(
        videos.withColumnRenamed("bvid", "post_id"), "post_id")
    return posts.groupBy("keyword", utc_day(F.col("pubdate")).alias("day")).agg(
        F.count(F.lit(1)).alias("n_posts"), F.sum("view").alias("total_views"))
