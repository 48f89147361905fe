"""Embedding near-dedup by lattice hashing.

1. Equal vectors are one node with a number of copies.
2. In each of ``TABLES`` tables a vector's direction is projected at random to ``PARTS`` times
   eight dimensions, and every eight are decoded to the nearest point of the E8 lattice; the
   points together are the vector's cell. It is also entered in the ``PROBES`` neighbouring cells
   that are nearest: where a shortest lattice step brings the point of one part closest.
3. Vectors that meet in a cell are compared; those near the limit become edges (a spanning forest
   per task), connected candidates become groups. Large cells are compared in blocks.
4. In every group all pairs are verified by cosine in double precision, in pairs of blocks, and
   counted, not emitted.

Defined results: vectors that are null, zero, or hold null or non-finite components are linked
with nothing, as are vectors of different lengths with each other; copies are linked; a row
without an id is left out of every group and is its own (null) component; rows that repeat an id
are separate vectors of that id; an empty table gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm import words
from llm.components import components, roots
from llm.jaccard import in_blocks, near_edges
from llm.shared import arrow, cut, group_bounds, whole_groups
from llm.vectors import by_length, rows_of, unit, usable

SIMILAR = 0.95
# From this cosine on, vectors that meet become candidates of one group.
MAYBE = 0.94
TABLES, PARTS, PROBES = 7, 2, 6
# Projected directions per lattice unit: near vectors (cosine 0.95) move by about half a cell.
SCALE = 0.6
CELL_BLOCK, GROUP_BLOCK = 512, 512


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


_STEPS = _shortest()


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with even sum."""
    f = np.rint(y)
    odd = np.flatnonzero(f.sum(1) % 2 != 0)
    rest = y[odd] - f[odd]
    at = np.abs(rest).argmax(1)
    f[odd, at] += np.where(rest[np.arange(len(odd)), at] >= 0, 1, -1)
    return f


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the even points, or those moved by one half everywhere."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((np.square(y - a).sum(1) <= np.square(y - b).sum(1))[:, None], a, b)


def cells(v: np.ndarray) -> np.ndarray:
    """Hashes of the cells of every direction: one row per vector, ``TABLES * (1 + PROBES)``."""
    u, n = unit(v), v.shape[1]
    out = np.empty((len(v), TABLES, 1 + PROBES), np.uint64)
    rng = np.random.default_rng([17, n])
    for t in range(TABLES):
        project, shift = rng.normal(0, SCALE, (n, PARTS, 8)), rng.random((PARTS, 8))
        y = np.einsum("vn,npk->vpk", u, project) + shift
        point = np.stack([decode(y[:, p]) for p in range(PARTS)], 1)
        out[:, t, 0] = _name(point, t, n)
        gain = ((y - point) @ _STEPS.T).reshape(len(v), -1)
        best = np.argpartition(-gain, PROBES, 1)[:, :PROBES]
        for k in range(PROBES):
            moved = point.copy()
            part, step = best[:, k] // len(_STEPS), best[:, k] % len(_STEPS)
            moved[np.arange(len(v)), part] += _STEPS[step]
            out[:, t, 1 + k] = _name(moved, t, n)
    return out.reshape(len(v), -1)


def _name(point: np.ndarray, table: int, n: int) -> np.ndarray:
    whole = np.rint(2 * point.reshape(len(point), -1)).astype(np.int64).view(np.uint64)
    h = words.mix(np.full(len(point), table * 65537 + n, np.uint64))
    for k in range(whole.shape[1]):
        h = words.mix(h * np.uint64(0x9E3779B97F4A7C15) + whole[:, k])
    return h


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = batch.column("node").to_numpy()
        for rows, v in by_length(batch.column("v")):
            for lo in range(0, len(rows), 1024):
                h = cells(v[lo : lo + 1024])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(node[rows[lo : lo + 1024]], h.shape[1])),
                     pa.array(h.ravel().view(np.int64))], ["node", "cell"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["cell", "lo", "hi"]
    for table in whole_groups(batches, keys):
        length = pa.concat_arrays(table.column("v").chunks).value_lengths().to_numpy()
        padded = np.zeros((table.num_rows, length.max()), np.float32)
        for rows, v in by_length(table.column("v")):
            padded[rows, : v.shape[1]] = unit(v)
        yield from near_edges(
            lambda i, j: (np.einsum("ij,ij->i", padded[i], padded[j]) >= MAYBE)
            & (length[i] == length[j]), table, keys)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links within each pair of blocks of a group."""
    keys = ["component", "lo", "hi"]
    for table in whole_groups(batches, keys):
        bounds = group_bounds(table, keys)
        node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        copies = table.column("copies").to_numpy()
        apart = table.column("lo").to_numpy() != table.column("hi").to_numpy()
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            u = unit(rows_of(table.column("v").slice(a, b - a)))
            linked = u @ u.T >= SIMILAR
            np.fill_diagonal(linked, False)
            if apart[a]:
                linked &= own[a:b][:, None] != own[a:b][None, :]
            i, j = np.nonzero(np.triu(linked))
            root = roots(b - a, i, j, node[a:b])
            some = linked.any(1)
            out.append(np.stack([node[a:b], linked @ copies[a:b], root], 1)[some])
        found = np.concatenate(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[:, k].astype(np.int64)) for k in range(3)], ["node", "links", "root"])


def near_dups(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors.select(
        F.col("vec_id"), F.col("vec_id").cast("bigint").alias("id"),
        F.col("embedding").cast("array<double>").alias("v"),
        (usable("embedding") & F.col("vec_id").isNotNull()).alias("ok"),
    ).withColumn("v", F.transform("v", lambda x: x + 0.0)).select(  # -0.0 is 0.0
        "*", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("second"), "v").alias("k2"))
    nodes = cut(rows.where("ok").groupBy("k1", "k2").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")
    ).withColumn("node", F.xxhash64("k1", "k2")), "nodes")
    entries = cut(arrow(nodes.select("node", "v"), _entries, "node bigint, cell bigint"), "cells")
    sizes = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = entries.join(sizes, "cell").join(nodes.select("node", "v"), "node")
    spread = in_blocks(met, "cell", "n", CELL_BLOCK)
    edges = arrow(spread.select("cell", "lo", "hi", "own", "node", "v")
                  .sortWithinPartitions("cell", "lo", "hi"), _candidates, "a bigint, b bigint")
    groups = components(edges)
    groups = groups.join(
        groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    members = groups.join(nodes.select("node", "copies", "v"), "node")
    spread = in_blocks(members, "component", "n", GROUP_BLOCK)
    found = cut(arrow(
        spread.select("component", "lo", "hi", "own", "node", "copies", "v")
        .sortWithinPartitions("component", "lo", "hi"),
        _links, "node bigint, links bigint, root bigint"), "links")
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = linked.join(nodes.select("node", "first"), "node")
    named = named.join(named.groupBy("component").agg(F.min("first").alias("component_id")),
                       "component").select("node", "component_id")
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    result = (
        nodes.drop("v").join(named, "node", "left").join(total, "node", "left")
        .select("k1", "k2", F.coalesce("component_id", "first").alias("component_id"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    good = rows.where("ok").select("vec_id", "id", "k1", "k2").join(result, ["k1", "k2"]).select(
        "vec_id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return good.union(rows.where("not ok").select(
        "vec_id", F.lit(0).cast("bigint"), "id", F.lit(True)))
