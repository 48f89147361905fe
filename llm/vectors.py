"""Columns of embeddings as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: str) -> Column:
    """True for vectors that are not null, not zero, and have only finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(
        fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def doubles(vectors: DataFrame, *keep: str) -> DataFrame:
    """vec_id, v (array of doubles) of the usable rows, and ``keep``."""
    return vectors.where(usable("embedding")).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("v"), *keep)


def rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column whose values all have one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy().reshape(len(column), -1)


def by_length(column: pa.Array | pa.ChunkedArray):
    """(row numbers, matrix) for every vector length."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, rows_of(column.take(pa.array(rows)))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe from overflow and underflow."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.square(v).sum(1, keepdims=True))
