"""Approximate nearest neighbours by adaptive dimension scan.

Nearness is the inner product. A vector x is extended by one component to the length of the
longest vector, a query by zero; then the largest inner products are the smallest distances.

1. Lists: centroids are fitted (k-means on directions) on about ``SAMPLE`` vectors chosen by a hash of the rows;
   every vector is put in the list of its nearest centroid. A list of more than ``SLICE_ROWS``
   vectors is cut into slices, so a list with a third of all vectors is many tasks. A task holds the
   candidates of one slice; the queries that probe it stream past them.
2. A query probes the ``PROBES`` share of the lists whose centroids are nearest, in two turns. In the
   ``FIRST`` share of these it meets all vectors; the k-th best id found there is a true bound on its
   answer and the limit of the second turn.
3. In the second turn, vectors are rotated at random and read in blocks of ``BLOCK`` columns. After d of D
   columns the partial distance, scaled by D/d, estimates the whole; a candidate is abandoned when
   a test says that the whole is beyond the query's limit with high probability.
4. Survivors are ranked by the inner product of the original vectors in double precision.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part;
neither do rows without an id, nor vectors whose length is not the most frequent one (ties: the
shortest); rows that share an id ask together, count once as a candidate (by their best score) and
never answer their own id; rows equal in id and vector are one before anything is cut to k, and
every cut is to k distinct ids; fewer candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from llm.shared import arrow, cut, group_bounds
from llm.vectors import doubles, rows_of

QUERY_STEP = 20
K = 20
SAMPLE = 4_000
# Lists for n vectors: this times the square root of n.
LISTS = 0.4
MOST_LISTS = 1_024
SLICE_ROWS = 16_000
PROBES = 0.75
FIRST = 0.15
BLOCK = 16
# Width of the hypothesis test: larger abandons less.
EPSILON = 2.4
# Pairs of queries and candidates that are looked at together.
PAIRS = 1 << 19
# Share of pairs left in a scan from which on they are read one by one.
DENSE = 0.05


class Index:
    """Centroids and rotation; its size does not depend on the table."""

    def __init__(self, sample: np.ndarray, longest: float, rows: int):
        self.longest = longest
        n = sample.shape[1] + 1
        rng = np.random.default_rng(31)
        self.rotation = np.linalg.qr(rng.normal(size=(n, n)))[0]
        sample = self.stored(sample)
        lists = int(min(MOST_LISTS, np.ceil(LISTS * np.sqrt(rows)), len(sample)))
        self.centroids = _means(sample, lists)

    def extended(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.longest**2 - np.square(v).sum(1)))
        return np.concatenate([v, rest[:, None]], 1)

    def stored(self, v: np.ndarray) -> np.ndarray:
        return self.extended(v) @ self.rotation

    def asked(self, v: np.ndarray) -> np.ndarray:
        """Queries, scaled to the length of the stored vectors (which changes no order)."""
        v = v * (self.longest / np.sqrt(np.square(v).sum(1, keepdims=True)))
        return np.concatenate([v, np.zeros((len(v), 1))], 1) @ self.rotation

    def limits(self, ask: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The squared distance of :meth:`asked` queries at which the inner product is ``floor``
        (NaN: no limit)."""
        length = np.sqrt(np.square(ask).sum(1))
        limit = 2 * self.longest**2 - 2 * self.longest * floor / length
        return np.where(np.isnan(floor), np.inf, limit + 1e-9 * self.longest**2)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None, :] - 2 * a @ b.T)


def _means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(37)
    center = x[np.sort(rng.permutation(len(x))[:k])]
    for _ in range(rounds):
        near = _squares(x, center).argmin(1)
        count = np.bincount(near, minlength=len(center))
        total = np.zeros_like(center)
        np.add.at(total, near, x)
        center = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], center)
    return center


def _blocks(v: np.ndarray, ask: bool) -> list[np.ndarray]:
    """The blocks of columns, each with two more: the product of a block of queries and one of
    candidates is the squared distances within the block."""
    out = []
    for lo in range(0, v.shape[1], BLOCK):
        part = v[:, lo : lo + BLOCK]
        square, one = np.square(part).sum(1, keepdims=True), np.ones((len(part), 1))
        out.append(np.concatenate([-2 * part, square, one] if ask else [part, one, square], 1))
    return out


def scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray, blocks: list[np.ndarray] | None = None
         ) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that no test abandons, reading ``x`` in blocks of columns
    (``blocks``: those of :func:`_blocks`, if at hand). While more than ``DENSE`` of the pairs are
    left, a block is one matrix product over all of them; then only the pairs left are read."""
    n = x.shape[1]
    whole = blocks if blocks is not None else _blocks(x, False)
    asked = _blocks(q, True)
    i = j = None
    part, alive = np.zeros((len(q), len(x))), np.ones((len(q), len(x)), bool)
    for k, lo in enumerate(range(0, n, BLOCK)):
        hi = min(n, lo + BLOCK)
        slack = 1.0 if hi == n else hi / n * (1 + EPSILON / np.sqrt(hi)) ** 2
        if i is None and np.count_nonzero(alive) <= DENSE * alive.size:
            i, j = np.nonzero(alive)
            part = part[i, j]
        if i is None:
            part += asked[k] @ whole[k].T
            alive &= part <= (limit * slack + 1e-12)[:, None]
        else:
            part = part + np.square(q[i, lo:hi] - x[j, lo:hi]).sum(1)
            left = part <= limit[i] * slack + 1e-12
            i, j, part = i[left], j[left], part[left]
    return (i, j) if i is not None else np.nonzero(alive)


def in_lists(batches: Iterator[pa.RecordBatch], index: Index, k: int
             ) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of every query among the candidates of its (list, slice). Rows are sorted by
    list, slice and query: the candidates of a group are held, and the queries behind them, of
    which there may be any number, pass batch by batch. With a column ``floor`` (null: none) the
    candidates are scanned for inner products of at least that, without it all are met."""
    keys, group, held, x, blocks = ["list", "slice", "query"], None, [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        bounds = group_bounds(table, keys)
        for a, b in zip(bounds[:-1], bounds[1:]):
            at = (batch.column("list")[a].as_py(), batch.column("slice")[a].as_py())
            if at != group:
                group, held, x = at, [], None
            part = batch.slice(a, b - a)
            if not part.column("query")[0].as_py():
                held.append(part)
                continue
            if not held:
                continue
            if x is None:
                own = pa.Table.from_batches(held)
                ids, v = own.column("vec_id").to_numpy(), rows_of(own.column("v"))
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], v[order]
                distinct, starts = np.unique(ids, return_index=True)
                x, blocks = index.stored(v), None
            step = max(1, min(128, PAIRS // len(x)))
            for lo in range(0, part.num_rows, step):
                some = part.slice(lo, step)
                ask, asks = rows_of(some.column("v")), some.column("vec_id").to_numpy()
                if "floor" in some.schema.names:
                    floor = some.column("floor").to_numpy(zero_copy_only=False).astype(float)
                    blocks = _blocks(x, False) if blocks is None else blocks
                    i, j = scan(index.asked(ask), x, index.limits(ask, floor), blocks)
                else:
                    i, j = _met(ask, asks, v, starts, distinct, k)
                yield _best(k, asks, ask, ids, v, i, j)


def _met(ask, asks, v, starts, distinct, k) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs among which the ``k`` best other ids of each query are; the rows of
    an id are neighbours, from ``starts`` on."""
    score = ask @ v.T
    best = score if len(starts) == len(v) else np.maximum.reduceat(score, starts, axis=1)
    at = np.minimum(np.searchsorted(distinct, asks), len(distinct) - 1)
    own = np.flatnonzero(distinct[at] == asks)
    if len(distinct) <= k + 1:
        return tuple(np.indices(score.shape).reshape(2, -1))
    best = best.copy() if best is score else best
    best[own, at[own]] = -np.inf
    last = np.partition(best, len(distinct) - k, 1)[:, len(distinct) - k]
    # A little below, because the scores that count are summed in another order.
    return np.nonzero(score >= (last - 1e-9 * (1 + np.abs(last)))[:, None])


def _best(k, asks, ask, ids, v, i, j) -> pa.RecordBatch:
    """The ``k`` best ids of the pairs (query i, candidate j) of every query."""
    other = asks[i] != ids[j]
    i, j = i[other], j[other]
    score = np.einsum("ij,ij->i", ask[i], v[j])
    # The best pair of every query and id, then the best ids.
    order = np.lexsort((-score, ids[j], i))
    i, j, score = i[order], j[order], score[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (ids[j[1:]] != ids[j[:-1]])
    i, j, score = i[new], j[new], score[new]
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return pa.RecordBatch.from_arrays(
        [pa.array(asks[i[top]]), pa.array(ids[j[top]]), pa.array(score[top])],
        ["query_id", "vec_id", "score"])


def build(vectors: DataFrame) -> tuple[DataFrame, Index | None]:
    """The usable vectors (vec_id, v), equal rows once, and the index fitted on their sample."""
    good = doubles(vectors).where(F.col("vec_id").isNotNull())
    good = cut(good.select("vec_id", "v").distinct(), "vectors")
    size = F.size("v")
    shape = good.groupBy(size.alias("n")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"),
    ).orderBy(F.desc("rows"), "n").first()
    if shape is None:
        return good, None
    good = good.where(size == shape["n"])
    share = min(1.0, SAMPLE / shape["rows"])
    # By id and vector, so the many vectors of one id do not enter together.
    pick = F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = (good if share == 1 else good.where(pick)).select("v").collect()
    v = sorted(r["v"] for r in rows)
    return good, Index(np.array(v).reshape(len(v), shape["n"]), shape["longest"], shape["rows"])


def nearest(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, probes: float = PROBES
            ) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every vector whose id is divisible by
    ``step``, among all others."""
    good, index = build(vectors)
    schema = "query_id bigint, vec_id bigint, score double"
    if index is None:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id",
                           F.lit(0.0).alias("score")).limit(0)
    lists = len(index.centroids)
    probed = max(1, int(np.ceil(probes * lists)))
    first = max(1, int(np.ceil(FIRST * probed)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of every list: its vectors (turn 0) and the queries that probe it (turn 1 or 2)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = rows_of(batch.column("v")), batch.column("vec_id").to_numpy()
            near = _squares(index.stored(v), index.centroids).argmin(1)
            asks = np.flatnonzero(ids % step == 0)
            parts = [(np.arange(len(v)), near, np.zeros(len(v)))]
            if len(asks):
                d = _squares(index.asked(v[asks]), index.centroids)
                best = np.argsort(d, 1, kind="stable")[:, :probed]
                turn = np.where(np.arange(probed) < first, 1, 2)
                parts.append((np.repeat(asks, probed), best.ravel(), np.tile(turn, len(asks))))
            for rows, at, turn in parts:
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int32)), pa.array(turn.astype(np.int32)),
                     taken.column("vec_id"), taken.column("v")],
                    ["list", "turn", "vec_id", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_lists(batches, index, k)

    rows = cut(arrow(good.select("vec_id", "v"), place,
                     "list int, turn int, vec_id bigint, v array<double>"), "lists")
    sizes = rows.where("turn = 0").groupBy("list").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(SLICE_ROWS)).cast("int").alias("slices"))
    sized = rows.join(sizes, "list")
    held = sized.where("turn = 0").withColumn(
        "slice", F.pmod(F.xxhash64("vec_id", "v", F.lit(5)), F.col("slices")).cast("int"))
    # A query goes to every slice of a list that it probes.
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    asked = sized.where("turn > 0").withColumn("slice", every)

    def turn(number: int, *floor: str) -> DataFrame:
        groups = ["list", "slice"]
        columns = [*groups, (F.col("turn") > 0).alias("query"), "vec_id", "v"]
        there = held.withColumn("floor", F.lit(None).cast("double")) if floor else held
        wanted = asked.where(F.col("turn") == number)
        if floor:
            wanted = wanted.join(floors, F.col("vec_id") == F.col("query_id"), "left")
        both = there.select(*columns, *floor).union(wanted.select(*columns, *floor))
        return arrow(both.repartition(*groups).sortWithinPartitions(*groups, "query"),
                     search, schema)

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    begun = cut(ranked(turn(1)), "first-turn")
    floors = begun.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    return ranked(begun.drop("rank").unionByName(turn(2, "floor"))).select(
        "query_id", "rank", "vec_id", "score")
