"""Least squares over any number of rows in one pass.

Output weights minimise |H b - y| with minimum norm.  Each task folds its rows
of [H | y] into an upper-triangular factor R (tall-skinny QR, Demmel et al. 2012)
and passes on the rows of R, at most ``width`` of them.
Rows of several factors are themselves rows of a smaller problem, so the same
fold runs again after a shuffle by bucket until a bounded number remain for the
driver.  Unlike normal equations this does not square the condition number.

A task holds one Arrow batch, its hidden outputs and one factor per group.
Which rows meet in which fold changes the answer by rounding only, and every
step is a function of its input, so a lost task can simply run again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.functions.arrow import matrix, numbers
from sensorlab.operators.elm.layer import Layer
from sensorlab.operators.features import as_array

# Singular values below this fraction of the largest count as zero.  A dense
# pseudo-inverse takes rows x machine epsilon, which is this for 45,000 rows;
# it is fixed here so that a fit does not change rank with the table's size.
RCOND = 1e-11

# Task outputs are spread over this many buckets of each part; a further level
# folds so many buckets into one.
BUCKETS = 1024
FAN_IN = 32

# Levels are added until the factors that reach the driver take no more than
# this, or are one of each part.
DRIVER_BYTES = 64 * 1024 * 1024

# Rows factored at once: small enough to stay in a core's cache.
FOLD_ROWS = 1000

# Scale of the weakest direction of a basis, as a fraction of the strongest, and
# how far, as a mean square, a block may leave the basis of a sample.
DEPTH = 1e-8
MISFIT = 1e4

FACTOR = "bucket int, part int, row array<double>"


def fold(factor: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """Triangular factor of the rows stacked below an earlier factor."""
    step = max(FOLD_ROWS, 4 * rows.shape[1])
    for start in range(0, len(rows), step):
        block = rows[start : start + step]
        stacked = block if factor is None else np.vstack([factor, block])
        factor = np.linalg.qr(stacked, mode="r")
    return factor


class RowFactor:
    """Factor of rows added block by block, at the speed of matrix products.

    A first sample is folded by QR.  Its singular vectors, scaled to unit size
    with the scale of the weakest held at ``DEPTH``, give a basis in which the
    rows are nearly orthonormal; in it a plain sum of products loses nothing
    that QR would keep (preconditioned Cholesky QR, after Fukaya, Yamamoto et
    al.).  A block that the basis does not fit, because it goes far where the
    sample was flat, is folded by QR and the basis drawn anew.
    """

    def __init__(self):
        self.factor: np.ndarray | None = None
        self.rows = 0
        self._basis: np.ndarray | None = None

    def add(self, block: np.ndarray) -> None:
        if not len(block):
            return
        if not np.isfinite(block).all():
            raise ValueError("a number among the rows is not finite")
        self.rows += len(block)
        if self._basis is not None:
            turned = block @ self._basis
            products = turned.T @ turned
            if products.diagonal().max() <= MISFIT * len(block):
                self._sum += products
                return
            self.settle()
        self.factor = fold(self.factor, block)
        if self.rows >= 4 * block.shape[1]:
            _, size, axes = np.linalg.svd(self.factor)
            size = np.maximum(size, DEPTH * size[0]) / np.sqrt(self.rows)
            if size[0] > 0:
                self._basis = axes[: len(size)].T / size
                self._back = size[:, None] * axes[: len(size)]
                self._sum = np.zeros((len(size), len(size)))

    def settle(self) -> np.ndarray | None:
        """The factor of all rows so far."""
        if self._basis is not None:
            size, axes = np.linalg.eigh(self._sum)
            turned = np.sqrt(np.maximum(size, 0.0))[:, None] * axes.T
            self.factor = fold(self.factor, turned @ self._back)
            self._basis = None
        return self.factor


def factor_batch(bucket: int, part: int, factor: np.ndarray) -> pa.RecordBatch:
    height, width = factor.shape
    offsets = pa.array(np.arange(height + 1, dtype=np.int32) * width)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(height, bucket, np.int32)),
            pa.array(np.full(height, part, np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(factor.reshape(-1))),
        ],
        names=["bucket", "part", "row"],
    )


def _refold() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fold factor rows that share a part; they go on under one of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors: dict[int, np.ndarray] = {}
        bucket = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").to_numpy()
            rows = matrix(batch.column("row"))
            bucket = int(batch.column("bucket")[0].as_py())
            for part in np.unique(parts).tolist():
                factors[part] = fold(factors.get(part), rows[parts == part])
        for part, factor in factors.items():
            yield factor_batch(bucket, part, factor)

    return run


def design_rows(
    df: DataFrame, make: Callable[[np.ndarray], Iterable[np.ndarray]], features: str, target: str,
    fold_column: str | None = None, blocks: int = 1,
) -> DataFrame:
    """Per task and part, the factor of [design | target].

    ``make`` turns a block of feature rows into ``blocks`` design matrices.
    Part ``fold * blocks + i`` holds design ``i`` of that fold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        factors: dict[int, RowFactor] = defaultdict(RowFactor)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column("x")), numbers(batch.column("y"))
            if batch.column("fold").null_count:
                raise ValueError("null fold among the rows")
            folds = batch.column("fold").to_numpy()
            present = np.unique(folds).tolist()
            # the design of a few rows is made and folded while it is in cache
            step = FOLD_ROWS * len(present)
            for start in range(0, len(y), step):
                part_of = folds[start : start + step]
                for i, design in enumerate(make(x[start : start + step])):
                    rows = np.column_stack([design, y[start : start + step]])
                    for f in present:
                        part = f * blocks + i
                        factors[part].add(rows if len(present) == 1 else rows[part_of == f])
        bucket = TaskContext.get().partitionId() % BUCKETS
        for part, rows in factors.items():
            factor = rows.settle()
            if factor is not None:
                yield factor_batch(bucket, part, factor)

    number = F.col(fold_column).cast("int") if fold_column else F.lit(0)
    rows = df.select(
        as_array(df, features).alias("x"),
        F.col(target).cast("double").alias("y"),
        number.alias("fold"),
    )
    return rows.mapInArrow(run, FACTOR)


def bucket_levels(width: int, parts: int) -> list[int]:
    """Buckets per part after each shuffle; known from the problem, not from the table."""
    levels = [BUCKETS]
    while levels[-1] > 1 and levels[-1] * parts * width * width * 8 > DRIVER_BYTES:
        levels.append(max(1, levels[-1] // FAN_IN))
    return levels


def gather(
    factors: DataFrame, width: int, parts: int = 1, empty_ok: bool = False
) -> dict[int, np.ndarray]:
    """Fold task factors down to one per part, by a tree of fixed fan-in.

    Parts are folded apart, so no task needs all of them.  What reaches the
    driver is at most ``DRIVER_BYTES``, or one factor of each part.
    """
    level = factors
    for buckets in bucket_levels(width, parts):
        level = level.withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
        level = level.repartition("part", "bucket").mapInArrow(_refold(), FACTOR)
    result: dict[int, np.ndarray] = {}
    table = level.select("part", "row").toArrow()
    numbers_ = table.column("part").to_numpy()
    if not len(numbers_):
        if empty_ok:
            return result
        raise ValueError("cannot fit on an empty table")
    rows = matrix(table.column("row"))
    for part in np.unique(numbers_).tolist():
        result[part] = fold(None, rows[numbers_ == part])
    return result


def solve(factor: np.ndarray, columns: int | None = None, rcond: float = RCOND) -> np.ndarray:
    """Minimum-norm weights of the first ``columns`` design columns.

    The last column of the factor is the target.  Taking fewer design columns
    answers the narrower problem exactly: column norms and angles are kept by QR.
    """
    columns = factor.shape[1] - 1 if columns is None else columns
    return np.linalg.lstsq(factor[:, :columns], factor[:, -1], rcond=rcond)[0]


def fit_layer(
    df: DataFrame, layer: Layer, features: str = "features", target: str = "binaryLabel",
    rcond: float = RCOND,
) -> np.ndarray:
    """Output weights of a hidden layer, from one scan of the table."""
    tasks = design_rows(df, lambda x: [layer.outputs(x)], features, target)
    return solve(gather(tasks, layer.nodes + 1)[0], rcond=rcond)


def gram(df: DataFrame, design: list, target) -> DataFrame:
    """Moments (i, j, value) of design column expressions; j = -1 is the target.

    Additive over rows, and readable in SQL; meant for audits of narrow layers,
    because solving with them loses half the digits.
    """
    n = len(design)
    staged = df.select(*[c.alias(f"h{i}") for i, c in enumerate(design)], target.alias("y"))
    sums = [
        (i, j, F.sum(F.col(f"h{i}") * F.col(f"h{j}"))) for i in range(n) for j in range(i, n)
    ] + [(i, -1, F.sum(F.col(f"h{i}") * F.col("y"))) for i in range(n)]
    wide = staged.agg(*[s.alias(f"s{k}") for k, (_, _, s) in enumerate(sums)])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{k}").alias("value"))
            for k, (i, j, _) in enumerate(sums)
        ]
    )
    return wide.select(F.inline(rows))


def layer_moments(
    df: DataFrame, layer: Layer, targets: list, features: str = "features"
) -> DataFrame:
    """Sum over rows of each node's output times each target, as (node, target, value).

    The form of :func:`gram` for wide layers: a task sends one nodes x targets
    matrix, and their sum is an ordinary aggregate.
    """

    width = len(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((layer.nodes, width))
        for batch in batches:
            x, t = matrix(batch.column("x")), matrix(batch.column("t"))
            for start in range(0, len(t), FOLD_ROWS):
                total += layer.outputs(x[start : start + FOLD_ROWS]).T @ t[start : start + FOLD_ROWS]
        nodes = np.repeat(np.arange(layer.nodes, dtype=np.int32), width)
        numbers_ = np.tile(np.arange(width, dtype=np.int32), layer.nodes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes), pa.array(numbers_), pa.array(total.reshape(-1))],
            names=["node", "target", "value"],
        )

    rows = df.select(as_array(df, features).alias("x"), F.array(*targets).alias("t"))
    sums = rows.mapInArrow(run, "node int, target int, value double")
    return sums.groupBy("node", "target").agg(F.sum("value").alias("value"))
