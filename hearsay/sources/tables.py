"""Reading the normalized tables."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearsay.operators.merge import evolve
from hearsay.schema import SCHEMAS, TABLE_KEYS

# The content tables of a full dump, in its order.
DUMP_TABLES = (
    "bili_videos bili_comments bili_dynamics bili_search zhihu_questions zhihu_answers "
    "zhihu_columns zhihu_articles zhihu_search weibo_posts weibo_comments tieba_threads "
    "tieba_comments"
).split()


def read_table(spark: SparkSession, root: str, table: str, fmt: str = "parquet") -> DataFrame:
    """A table below ``root`` with its declared schema; columns a file lacks are NULL."""
    return spark.read.format(fmt).schema(SCHEMAS[table]).load(f"{root}/{table}")


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables below ``root``. Lazy: nothing is read yet."""
    return {t: read_table(spark, root, t) for t in SCHEMAS}


def widened(df: DataFrame) -> DataFrame:
    """A scan with at least one partition per core, for text work on small inputs.

    A file of few row groups is read by few tasks, however expensive the expressions on its
    texts are. Such a scan is spread over the cores; an input with enough splits, as any
    large one has, is returned as it is and pays no shuffle. Only for plain scans.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty folders for tables that do not exist yet; existing ones are left alone."""
    for table, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{table}")


def write_table(df: DataFrame, root: str, table: str, buckets: int = 0) -> None:
    """Write a table. With ``buckets`` it is saved as a bucketed catalog table on its key, so
    later joins and merges on the key need no shuffle."""
    rows = evolve(df, SCHEMAS[table])
    if buckets:
        rows.write.bucketBy(buckets, *TABLE_KEYS[table]).sortBy(*TABLE_KEYS[table]).option(
            "path", f"{root}/{table}").mode("overwrite").saveAsTable(table)
    else:
        rows.write.mode("overwrite").parquet(f"{root}/{table}")


def scan(df: DataFrame, where: str | None = None, parse_raw: bool = False) -> DataFrame:
    """Rows of a table or view under a free SQL predicate; ``parse_raw`` adds ``raw_parsed``,
    the payload as a variant (NULL where absent or not JSON)."""
    if where:
        df = df.where(where)
    if parse_raw and "raw" in df.columns:
        df = df.withColumn("raw_parsed", F.try_parse_json(F.nullif("raw", F.lit(""))))
    return df


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, empty tables left out."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts.where(F.col("n_rows") > 0)
