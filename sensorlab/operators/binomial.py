"""Binomial models by reweighted triangular factors, with their whole summary.

Each step folds rows sqrt(w) [1 | x | z] of weights and working answers into one triangular factor, one
scan a step; its last column solves for the coefficients and its inverse gives their errors.
Normal equations would square the condition, and standard errors lose their digits first.
The deviance travels in the same tree: as the root of a sum of squares it is a factor of width one.

Labels are 0 or 1; a null label or vector fails the job, as do rows whose columns are linearly
dependent. Steps end when the deviance changes by less than ``tol`` of itself, or after ``max_iter``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlab.functions.arrow import matrix, numbers
from sensorlab.operators.components import dot
from sensorlab.operators.elm.solver import BUCKETS, FACTOR, FOLD_ROWS, RowFactor, factor_batch, gather
from sensorlab.operators.features import as_array

#: Quantiles of the residuals in a summary, and the relative error of their ranks.
QUANTILES = {"min": 0.0, "first quartile": 0.25, "median": 0.5, "third quartile": 0.75, "max": 1.0}
RANK_ACCURACY = 1_000_000
#: A diagonal of the factor below this share of its column's length counts as dependent.
DEPENDENT = 1e-11


def _working_rows(weights: np.ndarray):
    """Per task, the factor of weighted rows (part 0) and the root of the deviance (part 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows, deviance, seen = RowFactor(), 0.0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            x, y = matrix(batch.column("x")), numbers(batch.column("y"))
            for at in range(0, len(y), FOLD_ROWS):
                own = np.column_stack([np.ones(len(x[at : at + FOLD_ROWS])), x[at : at + FOLD_ROWS]])
                target = y[at : at + FOLD_ROWS]
                eta = own @ weights
                p = 0.5 * (1 + np.tanh(0.5 * eta))
                w = np.maximum(p * (1 - p), 1e-12)
                root = np.sqrt(w)
                rows.add(np.column_stack([root[:, None] * own, root * eta + (target - p) / root]))
                deviance += float(2 * (np.logaddexp(0.0, eta) - target * eta).sum())
        bucket = TaskContext.get().partitionId() % BUCKETS
        if seen:
            yield factor_batch(bucket, 0, rows.settle())
            carried = np.zeros((1, len(weights) + 1))
            carried[0, 0] = math.sqrt(max(deviance, 0.0))
            yield factor_batch(bucket, 1, carried)

    return run


@dataclass
class Binomial:
    """A fitted model; the intercept comes first."""

    coefficients: np.ndarray
    errors: np.ndarray
    deviance: float
    null_deviance: float
    rows: int
    steps: int

    @property
    def z(self) -> np.ndarray:
        return self.coefficients / self.errors

    @property
    def p(self) -> np.ndarray:
        return np.array([math.erfc(abs(z) / math.sqrt(2)) for z in self.z])

    @property
    def aic(self) -> float:
        return self.deviance + 2 * len(self.coefficients)

    def probability(self, df: DataFrame, features: str = "features") -> Column:
        """Probability of label 1, in expressions only."""
        eta = dot(as_array(df, features), self.coefficients[1:]) + F.lit(float(self.coefficients[0]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))

    def residuals(self, df: DataFrame, features: str = "features", label: str = "binaryLabel") -> Column:
        """Deviance residual of every row."""
        eta = dot(as_array(df, features), self.coefficients[1:]) + F.lit(float(self.coefficients[0]))
        own = F.when(F.col(label) > 0.5, -eta).otherwise(eta)
        # log(1 + exp(own)) without overflow
        loss = F.greatest(own, F.lit(0.0)) + F.log1p(F.exp(-F.abs(own)))
        return F.when(F.col(label) > 0.5, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.sqrt(2 * loss)

    def summary(
        self, df: DataFrame, names: Sequence[str], features: str = "features", label: str = "binaryLabel"
    ) -> DataFrame:
        """(section, name, value): coefficients with errors, z and p, deviances, AIC, residual quantiles."""
        rows = []
        for name, *values in zip(["(intercept)", *names], self.coefficients, self.errors, self.z, self.p, strict=True):
            rows += zip(("estimate", "std_error", "z", "p"), [name] * 4, map(float, values))
        width = len(self.coefficients)
        rows += [
            ("fit", "null deviance", self.null_deviance),
            ("fit", "null freedom", float(self.rows - 1)),
            ("fit", "residual deviance", self.deviance),
            ("fit", "residual freedom", float(self.rows - width)),
            ("fit", "aic", self.aic),
        ]
        cuts = F.percentile_approx("r", list(QUANTILES.values()), RANK_ACCURACY)
        found = df.select(self.residuals(df, features, label).alias("r")).agg(cuts).first()[0]
        rows += [("residual", name, float(v)) for name, v in zip(QUANTILES, found)]
        return df.sparkSession.createDataFrame(rows, "section string, name string, value double")


def fit_binomial_factor(
    df: DataFrame, features: str = "features", label: str = "binaryLabel", tol: float = 1e-8, max_iter: int = 25
) -> Binomial:
    """Fit by one scan a step; keep the table first where it is costly to read."""
    rows = df.select(as_array(df, features).alias("x"), F.col(label).cast("double").alias("y"))
    odd = F.raise_error(F.lit("a label is neither 0 nor 1")).cast("double")
    checked = F.when(F.col("y").isin(0.0, 1.0), F.col("y")).otherwise(odd)
    n, ones = rows.agg(F.count("*"), F.sum(checked)).first()
    if not n:
        raise ValueError("cannot fit on an empty table")
    null = -2 * sum(m * math.log(m / n) for m in (ones, n - ones) if m)
    weights = np.zeros(len(rows.first()["x"]) + 1)
    before, steps = math.inf, 0
    while True:
        factors = gather(rows.mapInArrow(_working_rows(weights), FACTOR), len(weights) + 1, 2)
        deviance = float(factors[1][0, 0]) ** 2
        factor = factors[0][: len(weights)]
        triangle = factor[:, : len(weights)]
        lengths = np.linalg.norm(triangle, axis=0)
        if len(factor) < len(weights) or (np.abs(np.diag(triangle)) <= DEPENDENT * lengths).any():
            raise ValueError("columns of the rows are linearly dependent")
        if abs(before - deviance) <= tol * (abs(deviance) + 0.1) or steps == max_iter:
            errors = np.linalg.norm(np.linalg.inv(triangle), axis=1)
            return Binomial(weights, errors, deviance, null, int(n), steps)
        weights = np.linalg.solve(triangle, factor[:, -1])
        before, steps = deviance, steps + 1
