"""A batch of raw payloads into the normalized tables.

Payload columns: platform, endpoint, request_id, keyword, page_no, status, has_cookie, body, and
optionally fetched_at (epoch seconds); or payloads landed by :func:`hearsay.plans.linkage.land`.
``request_id`` is what was asked for: a video's aid or bvid, a question, answer, column, post
or thread id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hearsay.normalize import bili, tieba, weibo, zhihu
from hearsay.normalize.common import ORDER, get, parsed
from hearsay.normalize.responses import classify
from hearsay.operators.merge import evolve, insert_ignore, latest_wins, lists_to_json, upsert
from hearsay.operators.views import Tables
from hearsay.schema import SCHEMAS, TABLE_KEYS
from hearsay.sources import buckets as store

# Tables whose first row of a key stays, with what orders the rows of a batch.
FIRST_WINS = {
    "engagement_snapshots": ["view_count", "like_count", "comment_count"],
}


def normalize_batch(
    payloads: DataFrame, as_of: int, max_answers: int | None = None,
    max_comments: int | None = None, max_replies: int | None = None,
) -> dict[str, DataFrame]:
    """Normalized rows per table of one batch fetched at ``as_of``, and the engagement
    snapshots it implies. What has landed is kept whole unless a cap is given. Unusable responses are left out; each table reads only its own
    platform and endpoints."""
    classed = payloads if "outcome" in payloads.columns else classify(payloads)
    zero = F.lit(0).cast("bigint")
    met_at = F.lit(as_of) if "fetched_at" not in payloads.columns else F.coalesce(
        "fetched_at", F.lit(as_of))
    met = F.struct(met_at.cast("bigint").alias("at"),
                   F.coalesce(F.col("page_no").cast("bigint"), zero).alias("page"),
                   zero.alias("pos"))
    usable = classed.where(F.col("outcome") == "OK").drop("outcome").withColumn(ORDER, met)

    def of(platform: str, endpoint: str, **names: str) -> DataFrame:
        rows = usable.where((F.col("platform") == platform) & (F.col("endpoint") == endpoint))
        for new, kind in names.items():
            rows = rows.withColumn(new, F.col("request_id").try_cast(kind))
        return rows

    tags = latest_wins(bili.norm_tags(of("bili", "tags", aid="bigint")).withColumn(
        "_n", F.size("tags")), ["aid"], "_n").select("aid", "tags")
    videos = bili.norm_video(of("bili", "video"), tags)
    pages = of("zhihu", "page", question_id="bigint").withColumnRenamed("body", "html")
    questions = zhihu.norm_question(of("zhihu", "question", question_id="bigint")).unionByName(
        zhihu.embedded_questions(pages)
    )
    answers = zhihu.norm_answers(of("zhihu", "answers", question_id="bigint")).unionByName(
        zhihu.embedded_answers(pages, max_answers)
    )
    found = weibo.norm_cards(of("weibo", "search")).select("mblog", ORDER)
    shown = parsed(of("weibo", "status")).select(
        get("v", "data", "variant").alias("mblog"), ORDER)
    posts = weibo.long_text_override(
        weibo.norm_micropost(found.unionByName(shown), as_of),
        of("weibo", "extend", id="string"),
    )
    hits = tieba.norm_forum_feed(of("tieba", "forum"))
    threads = of("tieba", "thread", tid="string")
    bare = threads.select("tid", *[
        F.lit(None).cast(SCHEMAS["tieba_threads"][c].dataType if c in
                         SCHEMAS["tieba_threads"].fieldNames() else "string").alias(c)
        for c in tieba.HIT_COLUMNS if c != "tid"
    ]).join(hits.select("tid"), "tid", "left_anti")
    thread_rows = tieba.norm_thread(
        hits.select(*tieba.HIT_COLUMNS).unionByName(bare), threads, max_replies
    )
    rows = {
        "bili_videos": videos,
        "bili_comments": bili.norm_comments(of("bili", "comments", oid="bigint")),
        "bili_dynamics": bili.norm_dynamics(of("bili", "dynamics")),
        "bili_search": bili.norm_search(of("bili", "search")).where(F.col("bvid") != ""),
        "zhihu_questions": questions,
        "zhihu_answers": answers,
        "zhihu_columns": zhihu.norm_column(of("zhihu", "column", column_id="string")),
        "zhihu_articles": zhihu.norm_article(of("zhihu", "article")).unionByName(
            zhihu.norm_column_items(of("zhihu", "column_items", column_id="string"))),
        "zhihu_search": zhihu.norm_general_search(of("zhihu", "search")).where(
            F.col("target_id") != ""),
        "zhihu_answer_comments": zhihu.norm_answer_comments(
            of("zhihu", "comments", answer_id="bigint"), max_comments),
        "weibo_posts": posts,
        "weibo_comments": weibo.norm_hotflow(
            of("weibo", "comments", post_id="string"), as_of, max_comments),
        "tieba_threads": thread_rows,
        "tieba_comments": tieba.norm_floors(threads, max_replies),
    }
    seen_at = F.lit(as_of).cast("bigint")
    out = {}
    place = StructType.fromDDL("_at bigint, _page bigint, _pos bigint")
    for table, df in rows.items():
        flat = df.withColumns({f"_{n}": F.col(f"{ORDER}.{n}") for n in ("at", "page", "pos")})
        typed = evolve(
            lists_to_json(flat.drop(ORDER)).withColumn("fetched_at", seen_at),
            StructType([*SCHEMAS[table], *place]))
        # Of a record met twice in a batch the later row counts: by time, page and position.
        # Rows of one place, such as hits without a page, are ordered by their content.
        out[table] = latest_wins(
            typed.withColumn(ORDER, F.struct(*place.fieldNames(), F.xxhash64("raw"))),
            TABLE_KEYS[table], ORDER).select(SCHEMAS[table].fieldNames())
    out["engagement_snapshots"] = (
        bili.snapshots(out["bili_videos"])
        .unionByName(zhihu.snapshots(out["zhihu_questions"]))
        .unionByName(weibo.snapshots(out["weibo_posts"]))
        .unionByName(tieba.snapshots(out["tieba_threads"]))
    )
    return out


def apply_batch(
    base: Tables, batch: Tables, as_of: int, null_overwrites: bool = True
) -> dict[str, DataFrame]:
    """The tables with a batch merged in: upsert by key, snapshots appended once per second.

    Applying a batch twice gives the same tables.
    """
    out = dict(base)
    for table, rows in batch.items():
        if table in FIRST_WINS:
            out[table] = insert_ignore(
                base[table], rows, TABLE_KEYS[table], FIRST_WINS[table])
        else:
            updates = rows.withColumn("_at", F.lit(as_of).cast("bigint"))
            out[table] = upsert(base[table], updates, TABLE_KEYS[table], "_at", null_overwrites)
    return out


def save_tables(tables: Tables, root: str, version: str) -> str:
    """Write a new version of the tables beside the old one, which its readers may still use."""
    out = f"{root.rstrip('/')}/version={version}"
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{table}")
    return out


def merge_batch(
    spark: SparkSession, root: str, batch: Tables, as_of: int, null_overwrites: bool = True,
    buckets: int = 256,
) -> dict[str, int]:
    """Merge a batch into the bucketed tables below ``root``, making those that are missing; the
    version of each afterwards. Only buckets with a row of the batch are rewritten. A table is
    switched on its own; running a batch again after a failure completes it."""
    out = {}
    for table, rows in batch.items():
        path = f"{root.rstrip('/')}/{table}"
        if not store.versions(spark, path):
            store.create(spark.createDataFrame([], SCHEMAS[table]), path, TABLE_KEYS[table], buckets)
        if table in FIRST_WINS:
            done = store.append_new(spark, path, rows, FIRST_WINS[table])
        else:
            updates = rows.withColumn("_at", F.lit(as_of).cast("bigint"))
            done = store.merge(spark, path, updates, "_at", null_overwrites)
        out[table] = done.number
    return out
