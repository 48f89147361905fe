"""Chat formatting with collapse of cumulative snapshots.

A log often holds a conversation again and again while it grows. A conversation is dropped when
its turns are the first turns of a longer one, or when an equal one has a smaller id; the rest is
rendered.

1. Turns are ordered by (turn, role, text), and numbered. Long conversations are numbered and
   summed in blocks of turns, so none has to fit one task.
2. The hash of a prefix is the sum of its turns' hashes, each of which covers the turn's number,
   role and text: three sums of 40 bits that roll along the conversation.
3. Equal conversations are one row; prefixes that end before their conversation does are
   distinct rows; an anti-join on (length, hashes) leaves the maximal conversations.
4. They are rendered in parts of ``PART`` turns; the parts in order are the conversation.

Defined results: rows that are equal in all four columns count once; a null turn sorts first, null
roles and texts are empty when rendered but differ from empty ones when compared; rows without a
conv_id belong to no conversation; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1_024
PART = 1_000
_LOW40 = (1 << 40) - 1


def _hashes() -> list[Column]:
    turn = [F.col("k"), F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    a, b = F.xxhash64(*turn), F.xxhash64(F.lit("second"), *turn)
    low = F.lit(_LOW40)
    return [a.bitwiseAND(low), F.shiftrightunsigned(a, 24), b.bitwiseAND(low)]


def _running(rows: DataFrame, sums: dict[str, Column], order: list[Column]) -> DataFrame:
    """Running totals of ``sums`` along each conversation, in blocks."""
    inside = Window.partitionBy("conv_id", "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    for name, value in sums.items():
        rows = rows.withColumn(f"_v_{name}", value)
    totals = rows.groupBy("conv_id", "_block").agg(
        *(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    offsets = totals.select("conv_id", "_block", *(
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    out = rows.select("*", *(F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in sums)).join(
        offsets, ["conv_id", "_block"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_s_{n}") + F.col(f"_o_{n}"))
    return out.drop(*(f"_{p}_{n}" for p in "vso" for n in sums))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, k (number of the turn from 1) and h1, h2, h3 (hash of the first
    k turns) of every turn."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", "role", "text").distinct()
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40)))
    rows = rows.withColumn("_block", block.cast("bigint"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    numbered = _running(rows, {"k": F.lit(1).cast("bigint")}, order)
    return _running(numbered, dict(zip(("h1", "h2", "h3"), _hashes())), [F.col("k")]).drop("_block")


def maximal(prefix: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that stay."""
    key = ["k", "h1", "h2", "h3"]
    length = prefix.groupBy("conv_id").agg(F.max("k").alias("n_turns"))
    # The last prefix of a conversation is the conversation itself.
    last = prefix.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("e")).select("conv_id", "e.*")
    whole = last.groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = prefix.select("conv_id", *key).join(length, "conv_id").where("k < n_turns")
    return whole.join(inner.select(*key).distinct(), key, "left_anti").select(
        "conv_id", F.col("k").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, part and rendered of the maximal conversations."""
    prefix = prefixes(turns)
    kept = prefix.select("conv_id", "k", "role", "text").join(maximal(prefix), "conv_id")
    blank = F.lit("")
    line = F.concat(F.lit("<|"), F.coalesce("role", blank), F.lit("|>\n"),
                    F.coalesce("text", blank), F.lit("\n"))
    part = F.floor((F.col("k") - 1) / PART).alias("part")
    lines = F.array_sort(F.collect_list(F.struct("k", line.alias("line"))))
    return kept.groupBy("conv_id", "n_turns", part).agg(
        F.concat_ws("", F.transform(lines, lambda t: t["line"])).alias("rendered"))


# The same by comparing the turns themselves.
SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations
               WHERE conv_id IS NOT NULL),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                                 role NULLS FIRST, text NULLS FIRST) AS k,
           count(*) OVER (PARTITION BY conv_id) AS n_turns
    FROM turns),
prefixed AS (
    SELECT *, list(struct_pack(r := role, t := text)) OVER (
        PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS prefix
    FROM numbered),
whole AS (SELECT min(conv_id) AS conv_id, prefix, k FROM prefixed WHERE k = n_turns
          GROUP BY prefix, k),
kept AS (SELECT conv_id, k AS n_turns FROM whole
         WHERE NOT EXISTS (SELECT 1 FROM prefixed p WHERE p.k < p.n_turns AND p.k = whole.k
                           AND p.prefix = whole.prefix))
SELECT n.conv_id, n.n_turns, CAST(floor((n.k - 1) / 1000) AS BIGINT) AS part,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10),
                  '' ORDER BY k) AS rendered
FROM numbered n JOIN kept USING (conv_id)
GROUP BY 1, 2, 3
"""
