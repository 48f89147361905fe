"""Training-order materialisation of token ids.

Documents are tokenized and cut into sequences of at most ``STRIDE`` ids. The sequences are
numbered 0 .. n-1 in an order of the data (hash slice, doc_id, piece, ids), a keyed Feistel network
permutes the numbers (numbers beyond n walk on along their cycle), and the image is the
sequence's slot in training order. Shard s holds the slots s * rows .. (s + 1) * rows - 1 as
records of one width, so a reader finds slot i at a computed byte and can stop and go on anywhere.

Slots are a permutation, so shards are equally large whatever the documents are. Records depend on
the rows and the key only, not on files, splits or cores; a task that runs again writes the same
bytes. Partitions hold ranges of whole shards, in slot order.

Defined results: a null text is an empty one, and every document closes with the id 0, so it has a
sequence; equal rows have sequences of their own; an empty table has no sequence. Records are
padded with 0 behind their ``length``. Only doc_id and text are read.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from llm import packing, words
from llm.shared import arrow, binary, cut, drop, group_bounds, scratch, whole_groups

STRIDE = 512
# Two bytes hold every id of the tokenizer (49,408).
TYPE, WIDTH = "<u2", 2
SHARD_ROWS = 8_192
KEY = 0x5EED
ROUNDS = 6
# Hash slices in which sequences are ranked; their counts come to the driver.
SLICES = 4_096
# Tasks that write shards, at most.
PARTS = 10_000
# Passes in which shards are written; each moves its own records only, so that no more than this
# share of them is on the executors' disks at once.
PASSES = 3
_U = np.uint64


def permute(number: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The images of ``number`` (each below ``n``) under a keyed permutation of 0 .. n-1."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)
    keys = words.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
                     + _U(key))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> _U(half), x & mask
        for k in keys:
            left, right = right, left ^ (words.mix(right + k) & mask)
        return (left << _U(half)) | right

    out = network(number.astype(np.uint64))
    walk = np.flatnonzero(out >= n)
    while len(walk):
        out[walk] = network(out[walk])
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


class _Numbered(NamedTuple):
    """Stored sequences, their number, and what a row's place in its slice is to be raised by."""

    table: DataFrame
    n: int
    base: np.ndarray


def _numbered(docs: DataFrame, stride: int, path: str | None) -> _Numbered:
    pieces = packing.pieces(docs, stride, path, with_ids=True, store=TYPE).drop("start")
    pieces = pieces.withColumn(
        "_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(SLICES)).cast("int"))
    # A slice is one run of rows of one file, whatever the number of files.
    table = cut(pieces.repartition("_slice").sortWithinPartitions(
        "_slice", "doc_id", "piece", "ids"), "tokens", codec="zstd", free=True)
    counts, first = np.zeros(SLICES, np.int64), np.zeros(SLICES, np.int64)
    rows = table.select("_slice", F.col("_metadata.row_index").alias("_row"))
    for r in rows.groupBy("_slice").agg(F.count(F.lit(1)), F.min("_row")).collect():
        counts[r[0]], first[r[0]] = r[1], r[2]
    return _Numbered(table, int(counts.sum()), np.cumsum(counts) - counts - first)


def _shard_count(n: int, shard_rows: int) -> int:
    return max(1, -(-n // shard_rows))


def _records(numbered: _Numbered, stride: int, shard_rows: int, key: int, low: int, high: int
             ) -> DataFrame:
    """The rows of :func:`materialise` of the shards ``low`` .. ``high - 1``."""
    table, n, base = numbered
    names = ["doc_id", "piece", "length", "ids_crc32", "ids"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = base[batch.column("_slice").to_numpy()] + batch.column("_row").to_numpy()
            slot = permute(number, n, key)
            own = pa.array((slot >= low * shard_rows) & (slot < high * shard_rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot)] + [batch.column(c) for c in names], ["slot", *names]).filter(own)

    slots = arrow(table.select("*", F.col("_metadata.row_index").alias("_row")), assign,
                  "slot bigint, doc_id bigint, piece int, length bigint, ids_crc32 bigint, "
                  "ids binary")
    shard = F.floor(F.col("slot") / F.lit(shard_rows)).cast("bigint")
    parts = min(PARTS, high - low)
    part = F.floor((F.col("shard") - F.lit(low)) * parts / F.lit(high - low)).cast("int")
    return (
        slots.withColumn("shard", shard)
        .repartitionById(parts, part)
        .sortWithinPartitions("slot")
        .select("slot", "shard", F.pmod("slot", F.lit(shard_rows)).alias("position"), "doc_id",
                "piece", "length", "ids_crc32",
                F.rpad("ids", F.lit(stride * WIDTH), F.lit(b"\0")).alias("record"))
    )


def materialise(docs: DataFrame, stride: int = STRIDE, shard_rows: int = SHARD_ROWS,
                key: int = KEY, path: str | None = None) -> DataFrame:
    """slot, shard, position (record in the shard), doc_id, piece, length, ids_crc32 (of the
    stored ids) and record (padded ids), each shard whole and sorted within one partition."""
    numbered = _numbered(docs, stride, path)
    return _records(numbered, stride, shard_rows, key, 0, _shard_count(numbered.n, shard_rows))


def _put(store: fs.FileSystem, base: str, shard: int, records: pa.ChunkedArray) -> str:
    """Write a shard; it appears under its name when it is complete."""
    name = f"{base}/shard-{shard:08d}.bin"
    part = f"{name}.{np.random.SeedSequence().entropy:x}"
    with store.open_output_stream(part) as f:
        for record in records:
            f.write(record.as_py())
    store.move(part, name)
    return name


def write_shards(records: DataFrame, folder: str) -> DataFrame:
    """Write every shard of :func:`materialise` as one file below ``folder`` (a URI that all
    executors reach) and return shard, path, rows. A shard appears under its name when it is complete."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["shard"]):
            bounds = group_bounds(table, ["shard"])
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base)
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                shard = table.column("shard")[a].as_py()
                name = _put(store, base, shard, table.column("record").slice(a, b - a))
                out.append((shard, name, b - a))
            shard, name, rows = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int64()), pa.array(name), pa.array(rows, pa.int64())],
                ["shard", "path", "rows"])

    return arrow(records.select("shard", "slot", "record"), write,
                 "shard bigint, path string, rows bigint")


def shards(docs: DataFrame, stride: int = STRIDE, shard_rows: int = SHARD_ROWS, key: int = KEY,
           path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the shards below ``folder`` (one of the shared folder, if none is given) and return
    the rows of :func:`materialise` with their records read back from the shard files. The rows
    without records are kept beside the shards; no record is stored twice. Shards are written in
    ``PASSES``, and the stored sequences are deleted when all are."""
    folder = folder or scratch(docs.sparkSession, "shards")
    width = stride * WIDTH

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["shard"]):
            bounds = group_bounds(table, ["shard"])
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base)
            for a, b in zip(bounds[:-1], bounds[1:]):
                _put(store, base, table.column("shard")[a].as_py(),
                     table.column("record").slice(a, b - a))
            yield from table.drop_columns(["record"]).to_batches()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            store, base = fs.FileSystem.from_uri(folder)
            at = batch.column("position").to_numpy()
            bounds = group_bounds(pa.Table.from_batches([batch]), ["shard"])
            for a, b in zip(bounds[:-1], bounds[1:]):
                low, high = int(at[a:b].min()), int(at[a:b].max()) + 1
                shard = batch.column("shard")[a].as_py()
                with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
                    f.seek(low * width)
                    data = f.read((high - low) * width)
                records = np.frombuffer(data, np.uint8).reshape(high - low, width)[at[a:b] - low]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    part.columns + [binary(records)], [*part.schema.names, "record"])

    schema = ("slot bigint, shard bigint, position bigint, doc_id bigint, piece int, "
              "length bigint, ids_crc32 bigint")
    numbered = _numbered(docs, stride, path)
    count = _shard_count(numbered.n, shard_rows)
    # Whole shards, as evenly as they go; the passes' rows lie in one folder each.
    bounds = [count * k // min(PASSES, count) for k in range(min(PASSES, count) + 1)]
    tables = [cut(arrow(_records(numbered, stride, shard_rows, key, low, high), write, schema),
                  "slots", free=True) for low, high in zip(bounds[:-1], bounds[1:])]
    drop(numbered.table)
    rows = docs.sparkSession.read.schema(schema).parquet(*(t.llm_path for t in tables))
    return arrow(rows, read, schema + ", record binary")


def read_slots(folder: str, first: int, count: int, stride: int = STRIDE,
               shard_rows: int = SHARD_ROWS) -> Iterator[np.ndarray]:
    """The padded ids of ``count`` slots from ``first`` on: sequential reads from any point."""
    store, base = fs.FileSystem.from_uri(folder)
    width = stride * WIDTH
    while count > 0:
        shard, position = divmod(first, shard_rows)
        take = min(count, shard_rows - position)
        with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek(position * width)
            data = f.read(take * width)
        yield from np.frombuffer(data, TYPE).reshape(-1, stride)
        first, count = first + take, count - take
