"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order. A document's virtual finish time is
the number of words of its source up to and including it, divided by the source's target. All
queues are served in order of that time, and the budget is spent at virtual time 1, because the
targets add up to the budget. Only Column expressions are used.

Defined results: a null text or one without words has size 0 and is never taken; a null source
is a source of its own, last in order; rows that are equal in id and text are equal documents;
an empty table gives an empty mix. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from llm.shared import cut, every_column

# Slices of the shuffled order of one source: a hot source is summed and ranked in that many
# independent pieces.
SLICES = 4096


def n_words(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    found = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++"))
    return F.coalesce(found, F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), budget_share: float = 1.5,
    max_epochs: int = 2,
) -> DataFrame:
    """(source, source_size, target) for a table of (source, size).

    Sources in code point order get ``weights`` in turn and share ``budget_share`` of all words;
    no target exceeds ``max_epochs`` times its source. That is a water level: with sources
    ordered by cap / weight, some first ones are full and the others stand at weight * level.
    The windows see one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("_n", (F.row_number().over(ordered) - 1) % len(weights))
        .withColumn("_w", F.get(cycle, F.col("_n")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_fill", F.col("_cap") / F.col("_w"))
    )
    by_fill = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    all_rows = Window.orderBy("_fill", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    full = F.coalesce(
        F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    open_weight = F.sum("_w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(all_rows) * F.lit(float(budget_share))
    levelled = sources.withColumn("_level", (budget - full) / open_weight)
    level = F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(all_rows)
    return levelled.select(
        "source", "source_size",
        F.least("_cap", F.coalesce(F.col("_w") * level, F.col("_cap"))).alias("target"),
    )


def schedule(docs: DataFrame, carry: Sequence[str | Column] = ("doc_id",), slices: int = SLICES,
             **targets) -> DataFrame:
    """One row per document: ``doc`` (struct of the ``carry`` columns), size, source_size,
    target, finish (virtual finish time of its first copy) and copies (how many are taken).

    A copy is taken when at least half of it is served by virtual time 1, so every source comes
    within half a document of its target. A source whose target exceeds its size is served a
    second round in the same order. The running totals are computed within hash slices of each
    source and shifted by the sums of the slices before.
    """
    rows = docs.select(
        F.struct(*carry).alias("doc"), "source", F.col("source").isNull().alias("_null"),
        F.coalesce("source", F.lit("")).alias("_name"), n_words("text").alias("size"),
        F.xxhash64("doc_id", "text").alias("_at"),
    ).withColumn("_slice", F.pmod(F.shiftright("_at", 40), F.lit(slices)).cast("int"))
    key = ["_null", "_name", "_slice"]
    sums = rows.groupBy("source", "_slice").agg(F.sum("size").alias("size"))
    # A few rows per source; written once because both the levels and the offsets read them.
    sums = cut(sums, "mix-sums")
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    per_source = source_targets(sums, **targets)
    offsets = sums.select(
        F.col("source").alias("_s"), "_slice",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_offset"),
    ).join(
        per_source.select(F.col("source").alias("_t"), "source_size", "target"),
        F.col("_s").eqNullSafe(F.col("_t")),
    ).select(
        F.col("_s").isNull().alias("_null"), F.coalesce("_s", F.lit("")).alias("_name"),
        "_slice", "_offset", "source_size", "target",
    )
    inside = Window.partitionBy(*key).orderBy("_at", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    served = rows.drop("source").withColumn("_inside", F.sum("size").over(inside)).join(
        offsets, key)
    total = F.col("_inside") + F.col("_offset")
    last = total - F.col("size") / 2
    taken = sum(
        (last + F.col("source_size") * n <= F.col("target")).cast("int")
        for n in range(int(targets.get("max_epochs", 2)))
    )
    return served.select(
        "doc", "size", "source_size", "target",
        F.when(F.col("target") > 0, total / F.col("target")).alias("finish"),
        F.when(F.col("size") > 0, taken).otherwise(0).alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the taken copies with all columns of ``docs``, globally sorted by
    virtual finish time. A document that is taken twice occurs twice, one round apart."""
    timed = schedule(docs, carry=every_column(docs), **options)
    copies = timed.where("copies > 0").select(
        "doc", "finish", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_round"),
        (F.col("source_size") / F.col("target")).alias("_lap"),
    ).withColumn("finish", F.col("finish") + F.col("_round") * F.col("_lap"))
    return (
        copies.repartitionByRange(F.col("finish"), F.col("doc.doc_id"))
        .sortWithinPartitions("finish", "doc.doc_id").select("doc.*")
    )
