"""What the operators on embeddings share: which vectors count, and batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: Column) -> Column:
    """True where a vector is there and none of its components is null, NaN or infinite."""
    return vector.isNotNull() & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def width_of(rows: DataFrame, column: str) -> int:
    """Components of the longest vector; 0 for an empty table."""
    return rows.agg(F.max(F.size(column))).first()[0] or 0


def matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype=np.float64) -> np.ndarray:
    """List column without nulls to one row a vector; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    full = np.zeros((len(column), width), dtype)
    full[np.arange(width) < sizes[:, None]] = flat
    return full
