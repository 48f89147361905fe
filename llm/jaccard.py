"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles; two texts are linked when their sets' Jaccard
similarity is at least 0.8. Equal texts are one node with a number of copies.

1. Every text is embedded by the smallest values of ``HASHES`` random functions of its shingles:
   each one is a token drawn from the set, and two sets draw the same one with probability equal
   to their similarity.
2. Chosen path: in each of ``RUNS`` runs a path of sampled tokens is extended step by step; which
   token is sampled next depends on the path so far. Texts on the same path form a bucket. A
   bucket of at most ``LEAF`` texts is a leaf, a larger one is split by the next token. At depth
   ``DEEPEST`` a bucket stays together, however large; it is then compared in blocks.
   A similar pair shares a path of depth d with probability at least 0.8^d. All runs draw from the
   same tokens, so they are not independent: over the number of equal tokens, Bin(64, 0.8), a pair at
   0.8 meets with probability 0.998 at depth 4 and 0.992 at depth 5.
3. Leaves are compared by the tokens' low bytes. Pairs that may be similar become edges (only a
   spanning forest leaves the task), and connected candidates become groups.
4. In every group all pairs are compared exactly, on the whole shingle sets. Large groups are cut
   into blocks and every pair of blocks is a task of its own, so no task holds a whole group.
   Linked pairs are counted, not emitted.

Defined results: a text with fewer than five words has one shingle, all its words; a text without
words (null, empty, blanks) is linked with nothing and is its own class; copies of a text are
linked with each other; a row without an id is known by a negative number made from its text; rows
with equal id and text are copies; different texts under one id are different texts, each with its
own links; a class is named by its smallest id, and of two texts of a class under that id only one
is kept; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from llm import words
from llm.components import components, roots
from llm.shared import (
    arrow, binary, cut, every_column, group_bounds, matrix, row_id, whole_groups,
)

SHINGLE = 5
SIMILAR = (4, 5)  # 0.8 as a fraction
HASHES = 64
SHALLOWEST, DEEPEST = 2, 5
TARGET_RECALL = 0.998
RUNS = math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - 0.8**DEEPEST))
LEAF = 1024
# Share of equal low bytes from which a pair is a candidate: four standard deviations below 0.8.
MAYBE = 0.6
# Texts per block of the two comparisons.
SKETCH_BLOCK, TEXT_BLOCK = 512, 256
# Pairs a task holds at a time (one group of two blocks may exceed it).
PAIRS = 1 << 19
_U = np.uint64
_RANDOM = np.random.default_rng(29).integers(1, 1 << 63, (2, HASHES), np.uint64) * _U(2) + _U(1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sampled tokens of every text; no value for a text without words."""
    for batch in batches:
        tokens = np.zeros((batch.num_rows, HASHES), np.uint32)
        some = np.zeros(batch.num_rows, bool)
        for c in words.chunks(batch.column("text")):
            h, bounds = words.shingles(c.raw, c.offsets, SHINGLE)
            full = np.flatnonzero(np.diff(bounds))
            if not len(full):
                continue
            some[c.lo + full] = True
            for k in range(HASHES):
                value = ((h ^ _RANDOM[0, k]) * _RANDOM[1, k]) >> _U(32)
                tokens[c.lo + full, k] = np.minimum.reduceat(value.astype(np.uint32), bounds[full])
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in ("id", "k1", "k2")] + [pa.array(some), binary(tokens)],
            ["id", "k1", "k2", "some", "tokens"])


def _first_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = matrix(batch.column("tokens"), np.uint32, HASHES)
        node = batch.column("node").to_numpy()
        for lo in range(0, len(node), 4096):
            t = tokens[lo : lo + 4096]
            path = np.tile(words.mix(np.arange(1, RUNS + 1, dtype=np.uint64)), (len(t), 1))
            for _ in range(SHALLOWEST):
                path = _extend(path, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(node[lo : lo + 4096], RUNS)),
                 pa.array(path.ravel().view(np.int64))], ["node", "path"])


def _extend(path: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    which = (path >> _U(40)).astype(np.int64) % HASHES
    return words.mix(path * _U(0x9E3779B97F4A7C15) + np.take_along_axis(tokens, which, 1) + _U(1))


def _next_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = matrix(batch.column("tokens"), np.uint32, HASHES)
        path = batch.column("path").to_numpy().view(np.uint64)[:, None]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(_extend(path, tokens)[:, 0].view(np.int64))],
            ["node", "path"])


def in_blocks(members: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Repeat each member of a group of ``size`` rows for every pair of blocks it takes part in:
    columns lo, hi (the pair) and own (its block). Groups of up to ``block`` rows are one block."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")
    return (
        members.withColumn("own", own)
        .withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("own", "_j")).withColumn("hi", F.greatest("own", "_j"))
        .drop("_j", size).repartition(key, "lo", "hi")
    )


def near_pairs(alike: Callable, bounds: np.ndarray, own: np.ndarray, apart: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of the same group for which ``alike(i, j)``. Groups are compared at
    distance 1, 2, ... between rows, all groups at once. In groups marked ``apart`` only rows of
    different blocks are compared."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    split = np.repeat(apart, np.diff(bounds))
    rows, left, right = np.arange(len(end)), [], []
    for k in range(1, int(np.diff(bounds).max(initial=0))):
        rows = rows[rows + k < end[rows]]
        for part in range(0, len(rows), 65536):
            i = rows[part : part + 65536]
            hit = alike(i, i + k)
            hit &= ~split[i] | (own[i] != own[i + k])
            left.append(i[hit])
            right.append(i[hit] + k)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def near_edges(alike: Callable, table: pa.Table, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the near pairs of every group of a table with columns node, own, lo
    and hi. Groups are taken together only up to ``PAIRS`` pairs, whatever the batch holds."""
    node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
    bounds = group_bounds(table, keys)
    apart = (table.column("lo").to_numpy() != table.column("hi").to_numpy())[bounds[:-1]]
    pairs = np.concatenate([[0], np.cumsum(np.square(np.diff(bounds)) // 2)])
    first = 0
    while first < len(apart):
        last = int(np.searchsorted(pairs, pairs[first] + PAIRS, "right")) - 1
        last = min(len(apart), max(first + 1, last))
        lo, hi = bounds[first], bounds[last]
        a, b = near_pairs(lambda i, j: alike(i + lo, j + lo), bounds[first : last + 1] - lo,
                          own[lo:hi], apart[first:last])
        name = node[lo:hi]
        root = roots(hi - lo, a, b, name)
        edge = np.unique(np.stack([name, root], 1)[root != name], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], ["a", "b"])
        first = last


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task a spanning forest of the pairs that may be similar."""
    keys, least = ["path", "lo", "hi"], math.ceil(MAYBE * HASHES)
    for table in whole_groups(batches, keys):
        sketch = matrix(table.column("sketch"), np.uint8, HASHES)
        yield from near_edges(
            lambda i, j: np.count_nonzero(sketch[i] == sketch[j], 1) >= least, table, keys)


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = matrix(batch.column("tokens"), np.uint32, HASHES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), binary(tokens.astype(np.uint8))], ["node", "sketch"])


def candidate_groups(texts: DataFrame) -> DataFrame:
    """(node, component) of texts that may be similar to another; ``texts`` has node, tokens."""
    texts = texts.select("node", "tokens")
    members = cut(arrow(texts, _first_paths, "node bigint, path bigint"), "paths")
    leaves = None
    for depth in range(SHALLOWEST, DEEPEST + 1):
        sizes = members.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        small = sizes if depth == DEEPEST else sizes.where(F.col("n") <= LEAF)
        leaf = members.join(small, "path")
        leaves = leaf if leaves is None else leaves.union(leaf)
        if depth == DEEPEST:
            break
        large = members.join(sizes.where(F.col("n") > LEAF), "path").select("node", "path")
        members = cut(arrow(large.join(texts, "node"), _next_paths, "node bigint, path bigint"),
                      "paths")
        if members.isEmpty():
            break
    low = arrow(texts, _low_bytes, "node bigint, sketch binary")
    spread = in_blocks(leaves.join(low, "node"), "path", "n", SKETCH_BLOCK)
    edges = arrow(spread.sortWithinPartitions("path", "lo", "hi"), _candidates,
                  "a bigint, b bigint")
    return components(edges)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of distinct numbers."""
    n = len(sets)
    out = np.zeros((n, n))
    values, where, count = np.unique(np.concatenate(sets), return_inverse=True,
                                     return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    keep = shared[where]
    owner, at = owner[keep], column[where[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(at, [lo, lo + width])
        part = np.zeros((n, min(width, int(shared.sum()) - lo)), np.float32)
        part[owner[a:b], at[a:b] - lo] = 1
        out += part @ part.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links within each pair of blocks: per text the copies it is linked with, and the
    smallest node it reaches."""
    keys = ["component", "lo", "hi"]
    num, den = SIMILAR
    for table in whole_groups(batches, keys):
        bounds = group_bounds(table, keys)
        node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        apart = table.column("lo").to_numpy() != table.column("hi").to_numpy()
        copies = table.column("copies").to_numpy()
        sets: list[np.ndarray] = []
        for c in words.chunks(table.column("text")):
            h, at = words.shingles(c.raw, c.offsets, SHINGLE)
            sets += [np.unique(h[at[i] : at[i + 1]]) for i in range(c.hi - c.lo)]
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            # A text that the table repeats under one id is here once.
            rows = a + np.unique(node[a:b], return_index=True)[1]
            if len(rows) < 2:
                continue
            size = np.array([len(sets[r]) for r in rows])
            both = overlaps([sets[r] for r in rows])
            linked = den * both >= num * (size[:, None] + size[None, :] - both)
            np.fill_diagonal(linked, False)
            if apart[a]:
                linked &= own[rows][:, None] != own[rows][None, :]
            i, j = np.nonzero(np.triu(linked))
            root = roots(len(rows), i, j, node[rows])
            some = linked.any(1)
            out.append(np.stack([node[rows], linked @ copies[rows], root], 1)[some])
        found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[:, k].astype(np.int64)) for k in range(3)], ["node", "links", "root"])


def _keyed(docs: DataFrame, *extra: Column) -> DataFrame:
    """id and a 128-bit key of the text, next to the text."""
    return docs.select(
        row_id().alias("id"), F.xxhash64("text").alias("k1"),
        F.xxhash64(F.lit("second"), "text").alias("k2"), F.col("text"), *extra)


def classes(docs: DataFrame) -> DataFrame:
    """One row per distinct text: k1, k2 (its key), some (it has words), first (its smallest id),
    class_id (smallest id reachable by links), leads (it stands for its class: the text of that
    id) and n_links (linked rows besides itself)."""
    rows = _keyed(docs)
    sketched = arrow(rows, _sketch,
                     "id bigint, k1 bigint, k2 bigint, some boolean, tokens binary")
    texts = cut(sketched.groupBy("k1", "k2").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"),
        F.first("some").alias("some"), F.first("tokens").alias("tokens")
    ).withColumn("node", F.xxhash64("k1", "k2")), "texts")
    groups = candidate_groups(texts.where("some"))
    groups = groups.join(
        groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    wanted = texts.where("some").select(
        F.col("first").alias("id"), "k1", "k2", "node", "copies").join(groups, "node")
    # Rows that repeat the id and the text are one member; the join has dealt them already.
    members = rows.join(wanted, ["id", "k1", "k2"]).dropDuplicates(["id", "k1", "k2"]).select(
        "component", "node", "copies", "n", "text")
    spread = in_blocks(members, "component", "n", TEXT_BLOCK)
    found = cut(arrow(
        spread.select("component", "lo", "hi", "own", "node", "copies", "text")
        .sortWithinPartitions("component", "lo", "hi"),
        _links, "node bigint, links bigint, root bigint"), "links")
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = linked.join(texts.select("node", "first"), "node")
    named = named.join(named.groupBy("component").agg(
        F.min(F.struct("first", "node")).alias("lead")), "component").select("node", "lead")
    return (
        texts.select("k1", "k2", "some", "node", "first", "copies")
        .join(total, "node", "left").join(named, "node", "left")
        .select("k1", "k2", "some", "first",
                F.coalesce("lead.first", "first").alias("class_id"),
                F.coalesce(F.col("lead.node") == F.col("node"), F.lit(True)).alias("leads"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and kept (it stays when one of each class does) of every row."""
    rows = _keyed(docs, F.col("doc_id")).drop("text")
    found = rows.join(classes(docs), ["k1", "k2"])
    own = F.when(F.col("some"), F.col("class_id")).otherwise(F.col("id"))
    return found.select(
        "doc_id", own.alias("class_id"),
        F.when(F.col("some"), F.col("n_links")).otherwise(F.lit(0)).alias("n_links"),
        (~F.col("some") | (F.col("leads") & (F.col("id") == own))).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with one of each class left, the one with the smallest id; texts without
    words all stay."""
    rows = _keyed(docs, F.struct(*every_column(docs)).alias("doc")).withColumn(
        "some", F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).drop("text")
    first = classes(docs).where(F.col("some") & F.col("leads")).select(
        F.col("first").alias("id"), "k1", "k2")
    # Joined by id and text: the copies of a text spread over all tasks.
    found = rows.where("some").join(first, ["id", "k1", "k2"])
    # Rows that repeat the id and the text.
    again = Window.partitionBy("id", "k1", "k2").orderBy("some")
    one = found.withColumn("_n", F.row_number().over(again)).where("_n = 1")
    return one.select("doc.*").union(rows.where("not some").select("doc.*"))
