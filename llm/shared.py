"""Helpers of the operators: durable intermediate tables and streaming over sorted groups."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from typing import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hearsay.session import shared_folder


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared folder."""
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, codec: str = "snappy", free: bool = False,
        **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither recompute it nor
    depend on the executors that made it. With ``free`` the write's shuffles are deleted when it
    is done, not when the driver's memory is next cleaned. ``options`` are the Parquet writer's."""
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        df.write.options(**options).parquet(path, compression=codec)
    finally:
        if free and before is None:
            spark.conf.unset(_FREE)
        elif free:
            spark.conf.set(_FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.llm_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.llm_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The document's id; a row without one gets a negative id from its text."""
    made = F.lit(-1).cast("bigint") - F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1))
    return F.coalesce(F.col(doc_id).cast("bigint"), made)


def slice_of(column: str | Column, slices: int) -> Column:
    """An even slice number 0 .. slices - 1 of a key."""
    return F.pmod(F.xxhash64(column), F.lit(slices)).cast("int")


def held_out(doc_id: str, of: int, remainder: int) -> Column:
    """True for rows whose crc32(doc_id as text) leaves ``remainder``; they are never learned."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % of == remainder, F.lit(False))


def every_column(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    """The name of a column as an expression."""
    return "`" + name.replace("`", "``") + "`"


def one_text_per_id(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` (_id and columns of its own, one row per id, few enough to be broadcast) with the
    text of its document. Of rows that share an id the one whose text has the smallest hash counts,
    so there are never more rows than ids."""
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(known), "_id")
    order = F.struct(F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"))
    return rows.groupBy(*known.columns).agg(F.min_by("text", order).alias("text"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Regroup a partition sorted by ``keys`` into tables that never split a key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
            if kept:
                new[0] |= kept[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py()
        borders = np.flatnonzero(new)
        if not len(borders):
            kept.append(batch)
            continue
        last = int(borders[-1])
        if kept or last:
            yield pa.Table.from_batches(kept + ([batch.slice(0, last)] if last else []))
        kept = [batch.slice(last)]
    if kept:
        yield pa.Table.from_batches(kept)


def group_bounds(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First row of every group of a sorted table, and the number of rows."""
    new = np.zeros(table.num_rows + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as one binary value each."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows)])


def matrix(column: pa.ChunkedArray | pa.Array, dtype, width: int) -> np.ndarray:
    """Inverse of :func:`binary`."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), dtype)
    _, where, data = column.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset :]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[len(column)]]
    return np.frombuffer(flat.tobytes(), dtype).reshape(len(column), width)


def arrow(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function over record batches.

    Whole texts pass through, so batches are made smaller than Spark's default unless the session
    has another size.
    """
    spark = df.sparkSession
    _ship(spark)
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "2000")
    return df.mapInArrow(fn, schema)


def _ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, by way of the shared folder, unless
    their search path has it."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or hasattr(context, "_llm"):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for package in ("llm", "hearsay"):
            for folder, _, names in os.walk(f"{root}/{package}"):
                for name in names:
                    if name.endswith(".py"):
                        full = f"{folder}/{name}"
                        z.write(full, os.path.relpath(full, root))
    target = f"{scratch(spark, 'package')}/llm-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(target)
    context._llm = target
