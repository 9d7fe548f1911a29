"""Principal components from a triangular factor of the rows.

The factor of [1 | X] is made in one scan, as for a network's fit. Its first row holds the column
means, and what lies below it is a factor of the centred rows: taking the column of ones first
downdates by the mean without forming a difference of large numbers. Singular values of that
small triangle are the spreads, its right singular vectors the components. A covariance matrix
would square the condition and lose the small components; this keeps them.

Rows are shifted by one of them first, which changes neither components nor spreads and keeps a
mean far from zero out of the arithmetic. A null or odd vector fails the job, as does a table of
fewer than two rows. A component's sign is that its largest weight is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlab.operators.elm.solver import design_rows, gather
from sensorlab.operators.features import as_array


def dot(values: Column, weights: np.ndarray) -> Column:
    """Product of an array column with fixed weights, as one expression."""
    pairs = F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


@dataclass
class Components:
    """Column means, components in columns, and the variance along each."""

    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    rows: int

    @property
    def shares(self) -> np.ndarray:
        total = self.variances.sum()
        return self.variances / total if total else np.zeros_like(self.variances)

    def project(
        self, df: DataFrame, k: int, source: str = "features", target: str = "components", centred: bool = False
    ) -> DataFrame:
        """Add the first ``k`` coordinates of every row as an array, in expressions only."""
        values = as_array(df, source)
        cells = [
            dot(values, axis) - F.lit(float(axis @ self.mean) if centred else 0.0)
            for axis in self.axes[:, :k].T
        ]
        return df.withColumn(target, F.array(*cells))

    def table(self, spark) -> DataFrame:
        """One row per component: its variance and share."""
        rows = [
            (i + 1, float(v), float(s)) for i, (v, s) in enumerate(zip(self.variances, self.shares))
        ]
        return spark.createDataFrame(rows, "component int, variance double, share double")


def fit_components(df: DataFrame, source: str = "features") -> Components:
    """All components of a vector column, from one scan."""
    values = as_array(df, source)
    first = df.select(values.alias("x")).first()
    if first is None:
        raise ValueError("components need two rows")
    shift = np.array(first["x"], float)
    rows = df.select(values.alias("x"), F.lit(1.0).alias("one"))
    # the last column counts the rows: it repeats the first
    tasks = design_rows(
        rows, lambda x: [np.column_stack([np.ones(len(x)), x - shift])], "x", "one"
    )
    factor = gather(tasks, len(shift) + 2)[0]
    count = int(round(float(factor[0, 0]) ** 2))
    if count < 2:
        raise ValueError("components need two rows")
    width = len(shift)
    mean = shift + factor[0, 1 : width + 1] / factor[0, 0]
    _, size, axes = np.linalg.svd(factor[1:, 1 : width + 1], full_matrices=True)
    size = np.r_[size, np.zeros(width - len(size))]
    axes = axes.T
    largest = axes[np.abs(axes).argmax(axis=0), np.arange(width)]
    axes = axes * np.where(largest < 0, -1.0, 1.0)
    return Components(mean, axes, size**2 / (count - 1), count)
