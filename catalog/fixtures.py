"""Adapters that shape the given tables into the discussion data model.

Each adapter is one SQL text used by both engines, so a difference in a query's result comes
from the operator under test. Every row of the source tables is used; the class of an id
(id % 5) only decides to which platform it belongs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from hearsay.operators.retrieve import Corpus
from hearsay.session import scratch_path
from hearsay.sources.tables import widened

PROSE = ("documents", "conversations", "pages")

PREFIX = {
    "bili": "https://www.bilibili.com/video/",
    "zhihu_question": "https://www.zhihu.com/question/",
    "weibo": "https://m.weibo.cn/detail/",
    "tieba": "https://tieba.baidu.com/p/",
}


def UP(k: str) -> str:
    """Unified platform of an id."""
    return (f"CASE {k} % 5 WHEN 0 THEN 'bili' WHEN 1 THEN 'zhihu_question' "
            f"WHEN 2 THEN 'zhihu_answer' WHEN 3 THEN 'weibo' ELSE 'tieba' END")


def LP(k: str) -> str:
    """Link platform of an id."""
    return (f"CASE {k} % 5 WHEN 0 THEN 'bili' WHEN 3 THEN 'weibo' WHEN 4 THEN 'tieba' "
            f"ELSE 'zhihu' END")


def LINKED(k: str) -> str:
    """The post a link names: answers are reached through their question."""
    return f"CASE WHEN {k} % 5 = 2 THEN {k} - 1 ELSE {k} END"


def COMMENT_PLATFORM(k: str) -> str:
    return (f"CASE {k} % 5 WHEN 0 THEN 'bili' WHEN 3 THEN 'weibo' WHEN 4 THEN 'tieba' "
            f"ELSE 'zhihu_answer' END")


def COMMENT_KEY(k: str) -> str:
    """What a comment hangs off: a video's aid, a question's first answer, or the post."""
    return (f"CASE {k} % 5 WHEN 0 THEN {k} + 1000000 WHEN 1 THEN {k} + 1 ELSE {k} END")


def URL(k: str) -> str:
    q, b, w, t = (PREFIX[p] for p in ("zhihu_question", "bili", "weibo", "tieba"))
    return (f"CASE {k} % 5 WHEN 0 THEN concat('{b}', CAST({k} AS STRING)) "
            f"WHEN 1 THEN concat('{q}', CAST({k} AS STRING)) "
            f"WHEN 2 THEN concat('{q}', CAST({k} - 1 AS STRING), '/answer/', "
            f"CAST({k} AS STRING)) "
            f"WHEN 3 THEN concat('{w}', CAST({k} AS STRING)) "
            f"ELSE concat('{t}', CAST({k} AS STRING)) END")


# {name} is a table or another adapter; EPOCH(x) is rendered per engine.
ADAPTERS: dict[str, str] = {
    "fx_links": f"""
SELECT o_orderpriority AS keyword, {LP('o_custkey')} AS platform,
       CAST({LINKED('o_custkey')} AS STRING) AS post_id,
       CAST(year(o_orderdate) * 100 + CAST(substring(o_orderpriority, 1, 1) AS INT) * 10
            + CASE WHEN o_custkey % 5 = 2 THEN 1 ELSE o_custkey % 5 END AS BIGINT) AS run_id,
       CAST(min(o_orderkey % 50) + 1 AS BIGINT) AS rank, min(EPOCH(o_orderdate)) AS fetched_at
FROM {{orders}} GROUP BY 1, 2, 3, 4""",
    "fx_runs": """
SELECT run_id, keyword, platform, CAST(100 AS BIGINT) AS requested_count,
       min(fetched_at) AS started_at,
       CASE WHEN run_id % 3 = 0 THEN NULL ELSE max(fetched_at) END AS finished_at,
       count(*) AS posts_fetched, CAST(sum(rank) AS BIGINT) AS comments_fetched,
       CAST(NULL AS STRING) AS config,
       CASE WHEN run_id % 3 = 0 THEN 'SoftBanned: empty page' END AS error
FROM {fx_links} GROUP BY run_id, keyword, platform""",
    "fx_base": """
SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_nationkey AS nation,
       pub, n_items, qty, n_ret, n_open, price
FROM {customer} LEFT JOIN (
  SELECT o_custkey, min(EPOCH(o_orderdate)) AS pub, count(*) AS n_items,
         CAST(sum(l_quantity) AS BIGINT) AS qty,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_ret,
         CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_open,
         CAST(sum(floor(l_extendedprice)) AS BIGINT) AS price
  FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey) a
ON o_custkey = c_custkey""",
    "fx_posts": f"""
SELECT {UP('k')} AS platform, CAST(k AS STRING) AS post_id, {URL('k')} AS url,
       CASE WHEN k % 5 <> 1 THEN CAST(nation AS STRING) END AS author_id,
       CASE WHEN k % 5 <> 1 THEN name END AS author_name,
       pub AS published_at,
       CASE WHEN k % 5 IN (0, 1, 4) THEN concat(name, ' ', seg) END AS title,
       seg AS content,
       CASE WHEN k % 5 IN (0, 1, 4) THEN seg END AS tags,
       n_items AS comment_count,
       CASE WHEN k % 5 IN (0, 2, 3) THEN qty END AS like_count,
       CASE WHEN k % 5 IN (0, 1) THEN n_ret END AS favorite_count,
       CASE WHEN k % 5 IN (0, 3) THEN n_open END AS share_count,
       CASE WHEN k % 5 IN (0, 1) THEN price END AS view_count,
       pub AS fetched_at
FROM {{fx_base}}""",
    "fx_comments": f"""
SELECT {COMMENT_PLATFORM('o_custkey')} AS platform,
       CAST({COMMENT_KEY('o_custkey')} AS STRING) AS post_id,
       concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
              CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS comment_id,
       CAST(l_suppkey AS STRING) AS author_id,
       concat('supplier ', CAST(l_suppkey AS STRING)) AS author_name,
       EPOCH(l_shipdate) AS published_at, p_name AS content,
       CASE WHEN o_custkey % 5 <> 4 THEN CAST(l_quantity AS BIGINT) END AS like_count,
       EPOCH(l_shipdate) AS fetched_at
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
JOIN {{part}} ON l_partkey = p_partkey""",
    "fx_videos": "SELECT CAST(c_custkey AS STRING) AS bvid, c_custkey + 1000000 AS aid "
                 "FROM {customer} WHERE " + UP("c_custkey") + " = 'bili'",
    "fx_answers": "SELECT c_custkey AS id, c_custkey - 1 AS question_id "
                  "FROM {customer} WHERE " + UP("c_custkey") + " = 'zhihu_answer'",
    # Prose: documents are posts, conversation turns their comments, the language the keyword.
    "fx_texts": f"""
SELECT {UP('doc_id')} AS platform, CAST(doc_id AS STRING) AS post_id, {URL('doc_id')} AS url,
       CAST(NULL AS STRING) AS author_id, source AS author_name,
       CAST(1704067200 + doc_id * 3600 AS BIGINT) AS published_at,
       CASE WHEN doc_id % 5 IN (0, 1, 4) THEN source END AS title, text AS content,
       lang AS tags, n_chars AS comment_count, n_chars AS like_count,
       n_chars AS favorite_count, n_chars AS share_count, n_chars AS view_count,
       CAST(1704067200 + doc_id * 3600 AS BIGINT) AS fetched_at
FROM {{documents}}""",
    "fx_text_links": f"""
SELECT lang AS keyword, {LP('doc_id')} AS platform,
       CAST({LINKED('doc_id')} AS STRING) AS post_id,
       CAST(doc_id % 5 AS BIGINT) AS run_id, CAST(1 AS BIGINT) AS rank,
       CAST(1704067200 + doc_id * 3600 AS BIGINT) AS fetched_at
FROM {{documents}}""",
    "fx_text_comments": f"""
SELECT {COMMENT_PLATFORM('conv_id')} AS platform,
       CAST({COMMENT_KEY('conv_id')} AS STRING) AS post_id,
       concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS comment_id,
       CAST(NULL AS STRING) AS author_id, role AS author_name,
       CAST(1704067200 + conv_id * 3600 + turn * 60 AS BIGINT) AS published_at,
       text AS content, turn AS like_count,
       CAST(1704067200 + conv_id * 3600 + turn * 60 AS BIGINT) AS fetched_at
FROM {{conversations}}""",
    "fx_text_videos": "SELECT CAST(doc_id AS STRING) AS bvid, doc_id + 1000000 AS aid "
                      "FROM {documents} WHERE " + UP("doc_id") + " = 'bili'",
    "fx_text_answers": "SELECT doc_id AS id, doc_id - 1 AS question_id "
                       "FROM {documents} WHERE " + UP("doc_id") + " = 'zhihu_answer'",
    "fx_replies": """
SELECT CAST(conv_id AS STRING) AS post_id,
       concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS comment_id,
       role AS author_name, turn AS floor, text AS content
FROM {conversations}""",
    "fx_snapshots": f"""
SELECT platform, post_id, fetched_at, CAST(sum(v) OVER w AS BIGINT) AS view_count,
       CAST(sum(l) OVER w AS BIGINT) AS like_count,
       CAST(sum(m) OVER w AS BIGINT) AS comment_count,
       CAST(sum(f) OVER w AS BIGINT) AS favorite_count,
       CAST(sum(s) OVER w AS BIGINT) AS share_count
FROM (SELECT {UP('user_id')} AS platform, CAST(user_id AS STRING) AS post_id,
        EPOCH(ts) - EPOCH(ts) % 86400 AS fetched_at,
        sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS v,
        sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS l,
        sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS m,
        sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS f,
        sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS s
      FROM {{events}} GROUP BY 1, 2, 3) t
WINDOW w AS (PARTITION BY platform, post_id ORDER BY fetched_at
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    # Normalized platform tables; together they hold every customer and every line item.
    "fx_bili_videos": f"""
SELECT CAST(k AS STRING) AS bvid, k + 1000000 AS aid, concat(name, ' ', seg) AS title,
       seg AS "desc", CAST(nation AS BIGINT) AS owner_mid, name AS owner_name, pub AS pubdate,
       CAST(60 AS BIGINT) AS duration, price AS "view", qty AS "like",
       n_ret AS coin, n_ret AS favorite, n_items AS reply, n_open AS share,
       n_items AS danmaku, seg AS tags, CAST(NULL AS STRING) AS raw, pub AS fetched_at
FROM {{fx_base}} WHERE {UP('k')} = 'bili'""",
    "fx_zhihu_questions": f"""
SELECT k AS id, concat(name, ' ', seg) AS title, seg AS detail, n_items AS answer_count,
       n_ret AS follower_count, price AS view_count, pub AS created, seg AS topics,
       CAST(NULL AS STRING) AS raw, pub AS fetched_at
FROM {{fx_base}} WHERE {UP('k')} = 'zhihu_question'""",
    "fx_zhihu_answers": f"""
SELECT k AS id, k - 1 AS question_id, CAST(nation AS STRING) AS author_id, name AS author_name,
       qty AS voteup_count, n_items AS comment_count, pub AS created_time, pub AS updated_time,
       seg AS content, CAST(NULL AS STRING) AS raw, pub AS fetched_at
FROM {{fx_base}} WHERE {UP('k')} = 'zhihu_answer'""",
    "fx_weibo_posts": f"""
SELECT CAST(k AS STRING) AS id, CAST(k AS STRING) AS mblogid, CAST(nation AS STRING) AS user_id,
       name AS user_name, seg AS text, CAST(NULL AS STRING) AS created_at, pub AS created_ts,
       CAST(NULL AS STRING) AS source, n_open AS reposts_count, n_items AS comments_count,
       qty AS attitudes_count, CAST(NULL AS STRING) AS raw, pub AS fetched_at
FROM {{fx_base}} WHERE {UP('k')} = 'weibo'""",
    "fx_tieba_threads": f"""
SELECT CAST(k AS STRING) AS tid, concat(name, ' ', seg) AS title, name AS author_name,
       CAST(nation AS STRING) AS author_id, seg AS forum_name, seg AS content,
       n_items AS reply_num, CAST(NULL AS STRING) AS created_at, pub AS created_ts,
       CAST(NULL AS STRING) AS url, CAST(NULL AS STRING) AS raw, pub AS fetched_at
FROM {{fx_base}} WHERE {UP('k')} = 'tieba'""",
    "fx_bili_comments": """
SELECT comment_id AS rpid, CAST(post_id AS BIGINT) AS oid, CAST(0 AS BIGINT) AS parent,
       CAST(author_id AS BIGINT) AS mid, author_name AS uname, content AS message,
       published_at AS ctime, like_count AS likes, CAST(NULL AS STRING) AS raw, fetched_at
FROM {fx_comments} WHERE platform = 'bili'""",
    "fx_zhihu_answer_comments": """
SELECT comment_id, CAST(post_id AS BIGINT) AS answer_id, author_id, author_name, content,
       like_count, published_at AS created_time, CAST(NULL AS STRING) AS raw, fetched_at
FROM {fx_comments} WHERE platform = 'zhihu_answer'""",
    "fx_weibo_comments": """
SELECT comment_id, post_id, author_id AS user_id, author_name AS user_name, content AS text,
       like_count, CAST(NULL AS STRING) AS created_at, published_at AS created_ts,
       CAST(NULL AS STRING) AS raw, fetched_at
FROM {fx_comments} WHERE platform = 'weibo'""",
    "fx_tieba_comments": """
SELECT comment_id AS pid, post_id AS tid, CAST(1 AS BIGINT) AS floor, author_name, author_id,
       content, CAST(NULL AS STRING) AS created_at, published_at AS created_ts,
       CAST(NULL AS STRING) AS raw, fetched_at
FROM {fx_comments} WHERE platform = 'tieba'""",
}

# Toy lexicon for the synthetic prose (own, arbitrary).
LEXICON = [
    ("positive", "and", 1.0), ("positive", "with", 1.5), ("positive", "this", 2.0),
    ("positive", "es", 1.2), ("positive", "der", 1.1), ("positive", "le", 1.4),
    ("negative", "worthless", 2.0), ("negative", "was", 1.0), ("negative", "from", 1.5),
    ("negative", "la", 1.2), ("negative", "die", 1.3),
    ("degree", "the", 1.5), ("degree", "of", 0.5), ("degree", "un", 1.8), ("degree", "in", 1.2),
    ("negation", "that", 1.0), ("negation", "is", 1.0), ("negation", "de", 1.0),
    ("negation", "to", 1.0),
]
TOKEN_REGEX = r"\p{L}+"
CLAUSES = r"[.!?;:,\n]+"
LETTER = r"\p{L}"
STOPWORDS = ["die", "der", "les", "le", "de", "of", "to"]


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Fixtures:
    """Adapters as DataFrames over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in ADAPTERS:
                sql = re.sub(
                    r"EPOCH\((\w+)\)",
                    r"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', "
                    r"CAST(\1 AS TIMESTAMP_NTZ))",
                    ADAPTERS[name],
                ).replace('"', "`")
                # Only adapters that hand on whole texts profit from more partitions.
                narrow = name in ("fx_text_links", "fx_text_videos", "fx_text_answers")
                parts = {n: self._read(n) if narrow else getattr(self, n) for n in _names(sql)}
                self._cache[name] = self.spark.sql(sql, **parts)
            else:
                df = self._read(name)
                self._cache[name] = widened(df) if name in PROSE else df
        return self._cache[name]

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, *names: str) -> Fixtures:
        """Adapters over the same tables, of which the named ones are computed once and written to
        the shared folder, for queries that read them several times."""
        out = Fixtures(self.spark, self.sf_dir)
        for name in names:
            df, path = getattr(self, name), scratch_path(self.spark, name)
            df.write.parquet(path)
            out._cache[name] = self.spark.read.schema(df.schema).parquet(path)
        return out

    @property
    def corpus(self) -> Corpus:
        return Corpus(
            posts=self.fx_posts, comments=self.fx_comments, links=self.fx_links,
            videos=self.fx_videos, answers=self.fx_answers, runs=self.fx_runs,
            snapshots=self.fx_snapshots,
        )

    @property
    def texts(self) -> Corpus:
        return Corpus(
            posts=self.fx_texts, comments=self.fx_text_comments, links=self.fx_text_links,
            videos=self.fx_text_videos, answers=self.fx_text_answers,
        )

    @property
    def tables(self) -> dict[str, DataFrame]:
        named = ("bili_videos zhihu_questions zhihu_answers weibo_posts tieba_threads "
                 "bili_comments zhihu_answer_comments weibo_comments tieba_comments").split()
        out = {t: getattr(self, f"fx_{t}") for t in named}
        return out | {"keyword_posts": self.fx_links, "scrape_runs": self.fx_runs,
                      "engagement_snapshots": self.fx_snapshots}

    @property
    def lexicon(self) -> DataFrame:
        import pyarrow as pa
        b, t, v = zip(*LEXICON)
        return self.spark.createDataFrame(
            pa.table({"bucket": list(b), "term": list(t), "value": list(v)})
        )

    def words(self, words: list[str]) -> DataFrame:
        import pyarrow as pa
        return self.spark.createDataFrame(pa.table({"word": words}))


def duck(sql: str, **ctes: str) -> str:
    """Oracle text: the adapters a query names, as CTEs in dependency order, then the query.

    ``ctes`` are further named parts, in the order given.
    """
    ordered: dict[str, str] = {}

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name not in ordered:
                need(ADAPTERS[name])
                body = re.sub(r"\{(\w+)\}", r"\1", ADAPTERS[name])
                body = re.sub(r"EPOCH\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", body)
                ordered[name] = body.replace("AS STRING", "AS VARCHAR").strip()

    for part in [*ctes.values(), sql]:
        need(part)
    ordered |= {k: v.strip() for k, v in ctes.items()}
    head = ",\n".join(f"{name} AS (\n{body}\n)" for name, body in ordered.items())
    return (f"WITH {head}\n" if head else "") + sql.strip()
