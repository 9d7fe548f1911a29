"""Pseudo-inverse of a tall table of row vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlab.functions.arrow import matrix
from sensorlab.operators.elm.solver import design_rows, gather
from sensorlab.operators.features import as_array


def singular_factors(
    df: DataFrame, width: int, source: str = "features", rcond: float = 1e-9
) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (as columns), from one scan.

    Raises where a singular value is zero relative to the largest.
    """
    staged = df.select(as_array(df, source).alias("x"), F.lit(0.0).alias("y"))
    factor = gather(design_rows(staged, lambda x: [x], "x", "y"), width + 1)[0]
    _, s, vt = np.linalg.svd(factor[:, :width])
    if len(s) < width or s[-1] <= rcond * s[0]:
        raise ValueError("matrix is singular: it has no inverse")
    return s, vt.T


def row_product(vector: Column, map_: np.ndarray) -> Column:
    """Each row vector times a small matrix, one product per Arrow batch."""

    @F.arrow_udf("array<double>")
    def apply(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        out = matrix(x) @ map_
        offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))

    return apply(vector)


def pseudo_inverse(
    df: DataFrame, width: int, source: str = "features", target: str = "pinv"
) -> DataFrame:
    """Add to each row its column of the pseudo-inverse.

    With rows A = U S V', the inverse is V S^-1 U'; the column that belongs to
    row a is V S^-2 V' a.  It stays with its row; nothing row-sized is collected.
    """
    s, v = singular_factors(df, width, source)
    return df.withColumn(target, row_product(as_array(df, source), (v / s**2) @ v.T))
