"""JSON and CSV exports. Every output is a folder of part files written in parallel."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from hearsay.functions.scalars import sanitize_keyword
from hearsay.operators.merge import lists_to_json
from hearsay.operators.retrieve import (
    Corpus, comment_keys, posts_for_run, run_comments, run_comments_order, run_post_keys,
)
from hearsay.schema import to_zh
from hearsay.session import scratch_path

BOM = "\ufeff"


def json_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All tables as rows (table_name, row JSON); non-ASCII text stays readable."""
    out = None
    for name, df in tables.items():
        part = df.select(
            F.lit(name).alias("table_name"),
            F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def export_json(tables: Mapping[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per table below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def export_csv(df: DataFrame, path: str, bom: bool = False, by: Sequence[str] = (),
               compression: str = "none") -> None:
    """CSV with a header; with ``bom`` every part file starts with a UTF-8 byte order mark.
    ``by`` names columns that become folders, ``compression`` a codec such as gzip."""
    flat = lists_to_json(df)
    if bom:
        first = next(c for c in flat.columns if c not in by)
        flat = flat.withColumnRenamed(first, BOM + first)
    # Quotes are doubled and empty strings kept apart from NULL, as spreadsheets expect.
    flat.write.mode("overwrite").partitionBy(*by).options(
        header=True, escape='"', quoteAll=False, emptyValue='""', nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression=compression,
    ).csv(path)


def export_run(
    c: Corpus, run_id: int, out_dir: str, include_comments: bool = True, chinese: bool = True
) -> dict[str, str]:
    """Posts, and comments if there are any, of one run as CSV folders.

    The folders are named after the run's keyword and id; an unknown run is an error.
    """
    found = (
        c.runs.where(F.col("run_id") == run_id)
        .select(sanitize_keyword(F.col("keyword")).alias("name")).head(1)
    )
    if not found:
        raise ValueError(f"run {run_id} not found")
    base = f"{out_dir.rstrip('/')}/{found[0]['name']}_run{run_id}"
    rename = to_zh if chinese else (lambda df: df)
    paths = {"posts": f"{base}_posts.csv"}
    export_csv(rename(posts_for_run(c, run_id)), paths["posts"], bom=True)
    if include_comments:
        # Found once: whether there are any is asked of what was stored, and so is their order.
        stored = scratch_path(c.links.sparkSession, "run-comments")
        run_comments(c, run_id).write.parquet(stored)
        comments = c.links.sparkSession.read.schema(c.comments.schema).parquet(stored)
        if not comments.isEmpty():
            paths["comments"] = f"{base}_comments.csv"
            export_csv(rename(comments.orderBy(*run_comments_order())), paths["comments"],
                       bom=True)
    return paths


def all_run_posts(c: Corpus, runs: DataFrame) -> DataFrame:
    """The posts of every run of ``runs`` (run_id and columns of its own), with the answers under its
    questions, and those columns."""
    keys = run_post_keys(c, c.links, ["run_id"]).join(runs, "run_id")
    return c.posts.join(keys, ["platform", "post_id"]).select(*runs.columns, *c.posts.columns)


def all_run_comments(c: Corpus, runs: DataFrame) -> DataFrame:
    """The comments of every run's posts, in the same way."""
    keys = comment_keys(c, c.links, ["run_id"]).join(runs, "run_id")
    return c.comments.join(keys, ["platform", "post_id"]).select(
        *runs.columns, *c.comments.columns)


# Folders that a task of export_all_runs holds open; beyond it sorts its rows by folder.
WRITERS = 512
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def export_all_runs(
    c: Corpus, out_dir: str, include_comments: bool = True, chinese: bool = True,
    compression: str = "none",
) -> dict[str, str]:
    """Posts (answers included) and comments of every run in one job each, as
    :func:`export_run` writes them, in folders of keyword and run.

    The keyword's folder carries a hash, so keywords that share their first characters do not
    share a folder. A post and its comments are written once per run that names the post, many times
    the corpus in all; so these rows are neither shuffled nor sorted: every task appends its
    own to a file per run. ``compression`` names a codec of the files.
    """
    spark = c.links.sparkSession
    runs = c.runs.select("run_id", F.concat_ws(
        "-", sanitize_keyword(F.col("keyword")), F.substring(F.md5("keyword"), 1, 8)
    ).alias("keyword_key"))
    rename = to_zh if chinese else (lambda df: df)
    tables = {"posts": all_run_posts}
    if include_comments:
        tables["comments"] = all_run_comments
    paths = {}
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, str(WRITERS))
    try:
        for name, rows in tables.items():
            paths[name] = f"{out_dir.rstrip('/')}/{name}.csv"
            export_csv(rename(rows(c, runs)), paths[name], bom=True,
                       by=["keyword_key", "run_id"], compression=compression)
    finally:
        spark.conf.set(_WRITERS, before)
    return paths
