"""Arrow columns as numpy arrays, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list<double> Arrow column as a rows x width array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("null vector among the rows")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("null inside a vector")
    values = flat.to_numpy(zero_copy_only=False)
    if len(column) and (column.value_lengths().to_numpy() != len(values) // len(column)).any():
        raise ValueError("vectors differ in length")
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def numbers(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("null target among the rows")
    return column.to_numpy(zero_copy_only=False).astype(np.float64)
