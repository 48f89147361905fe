"""The registered queries opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from llm import (
    alignment, chat, jaccard, lattice, leaks, mixing, packing, periods, quality, repeats,
    search, toxicity, training_order,
)

QUERIES = {}
ORACLES = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.schedule(table(spark, sf_dir, "documents")).select(
        "doc.doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(table(spark, sf_dir, "documents"))


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn(
        "predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@_query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that an earlier one has."""
    kept = repeats.remove(table(spark, sf_dir, "documents"), digest=True)
    return kept.select("doc.doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn(
        "predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@_query
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document under five-word Jaccard similarity 0.8."""
    return jaccard.join(table(spark, sf_dir, "documents"))


@_query
def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding under cosine 0.95."""
    return lattice.near_dups(table(spark, sf_dir, "embeddings"))


@_query
def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest others of every embedding whose id is divisible by 20."""
    return search.nearest(table(spark, sf_dir, "embeddings"))


@_query
def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token record of every sequence of every document in its slot of the training order, as
    read from the shards that it writes."""
    return training_order.shards(table(spark, sf_dir, "documents"))


@_query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return chat.render(table(spark, sf_dir, "conversations"))


ORACLES["op5_chat"] = chat.SQL


@_query
def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of them looped by rule."""
    docs = table(spark, sf_dir, "documents")
    made = docs.select("doc_id", periods.looped(F.col("doc_id"), F.col("text")).alias("text"))
    return periods.digest(periods.detect(made))


@_query
def op12_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that lie in a window of a benchmark item."""
    return leaks.report(
        leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLES["op12_leaks"] = leaks.SQL


@_query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers in every document."""
    found = alignment.align(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", *found.columns[1:])
