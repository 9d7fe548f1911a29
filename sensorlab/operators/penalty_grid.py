"""Logistic fits of a whole penalty grid on all folds, sharing every scan.

A penalty (strength, elastic net share) and a fold left out are one problem. All problems
take a Newton step per scan: tasks sum, for each of them, the loss, its gradient and
its curvature over the rows outside its fold, as one matrix product of a block's products
of features with all problems' row weights. The sums meet in one aggregate; the driver
holds one small system per problem and solves it, penalised absolute values included, by
cyclic descent on the quadratic (a proximal Newton step). A step that raises a problem's
objective is halved and tried again in the next scan. So the scans are those of the
slowest problem, however many points the grid has.

The objective is the mean logistic loss plus strength * (share * |w|_1 + (1 - share) / 2 *
|w|_2^2), where w are the weights of features scaled to unit deviation in the training
rows, and the intercept bears no penalty: that of Spark's estimator with its defaults. A feature that
is constant in the training rows has weight 0. An iteration limit counts Newton steps; fits that
reach the tolerance before it are the fits of every higher limit. Training rows of one class
without a penalty have no finite fit and stop at the limit; a null label or vector fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlab.functions.arrow import matrix, numbers
from sensorlab.operators.evaluate import areas_of_counts
from sensorlab.operators.features import as_array
from sensorlab.session import kept

#: Numbers of products that a block of rows makes at once, and steps that a problem may be halved.
BLOCK_CELLS, HALVINGS = 2_000_000, 30
TOLERANCE = 1e-10
SUMS = "problem int, sums array<double>"


@dataclass
class Problem:
    """One penalty on all rows outside one fold, or on all rows where ``fold`` is -1."""

    strength: float
    share: float
    fold: int
    limits: list[int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Factors of the penalty, and features that take part.
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    live: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    steps: int = 0
    halvings: int = 0
    done: bool = False
    origin: np.ndarray | None = None
    value: float = np.inf
    #: Weights at every limit that has been reached.
    at_limit: dict[int, np.ndarray] = field(default_factory=dict)

    def penalty(self, w: np.ndarray) -> float:
        own = w[1:] * self.scale
        return self.strength * (
            self.share * np.abs(own).sum() + (1 - self.share) / 2 * float(own @ own)
        )

    def settle(self) -> None:
        self.done = True
        for limit in self.limits:
            self.at_limit.setdefault(limit, self.weights)


def _newton_sums(centre: np.ndarray, deviation: np.ndarray, problems: list[tuple[int, int, np.ndarray]]):
    """Per task and problem: rows, loss, gradient and upper curvature."""
    weights = np.stack([w for _, _, w in problems], axis=1)
    out_folds = np.array([f for _, f, _ in problems])
    width = len(centre) + 1
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(problems), 2 + width + len(upper[0])))
        rows_at_once = max(BLOCK_CELLS // (len(upper[0]) + 3 * len(problems)), 64)
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            x, y = matrix(batch.column("x")), numbers(batch.column("y"))
            folds = batch.column("fold").to_numpy()
            for at in range(0, len(x), rows_at_once):
                part = slice(at, at + rows_at_once)
                design = np.ones((len(x[part]), width))
                np.divide(x[part] - centre, deviation, out=design[:, 1:])
                products = design[:, upper[0]] * design[:, upper[1]]
                # rows meet only the problems that do not leave out their fold
                for f in np.unique(folds[part]):
                    rows, others = folds[part] == f, out_folds != f
                    own, target = design[rows], y[part][rows, None]
                    z = own @ weights[:, others]
                    small = np.exp(-np.abs(z))
                    p = np.where(z < 0, small, 1.0) / (1 + small)
                    # log(1 + exp(z)) - y z without overflow
                    loss = np.maximum(z, 0.0) + np.log(1 + small) - target * z
                    total[others, 0] += len(own)
                    total[others, 1] += loss.sum(axis=0)
                    total[others, 2 : 2 + width] += (own.T @ (p - target)).T
                    total[others, 2 + width :] += (products[rows].T @ (small / (1 + small) ** 2)).T
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n for n, _, _ in problems], pa.int32()),
                    pa.array(list(total), pa.list_(pa.float64())),
                ],
                names=["problem", "sums"],
            )

    return run


def _moments(rows: DataFrame, width: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows, means and summed squares about them of every fold; one aggregate."""
    cells = [f(F.col("x")[i]) for i in range(width) for f in (F.avg, F.var_pop)]
    found = {}
    for row in rows.groupBy("fold").agg(F.count("*"), *cells).collect():
        values = np.array([np.nan if v is None else v for v in row[2:]], float)
        found[row[0]] = float(row[1]), values[0::2], values[1::2] * row[1]
    return found


def _joined(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    n, mean, square = 0.0, np.zeros_like(parts[0][1]), np.zeros_like(parts[0][1])
    for m, other, more in parts:
        gap = other - mean
        square = square + more + gap**2 * n * m / (n + m)
        mean = mean + gap * m / (n + m)
        n += m
    return n, mean, square


def _prox_step(h: np.ndarray, g: np.ndarray, problem: Problem) -> np.ndarray:
    """Weights that minimise the quadratic about the present ones plus the penalty."""
    w = problem.weights
    live = np.r_[True, problem.live]
    ridge = np.r_[0.0, problem.strength * (1 - problem.share) * problem.scale**2]
    curve = h + np.diag(ridge)
    slope = g + ridge * w
    absolute = np.r_[0.0, problem.strength * problem.share * problem.scale]
    out = w.copy()
    if not absolute.any():
        own = np.ix_(live, live)
        out[live] -= np.linalg.lstsq(curve[own], slope[live], rcond=1e-15)[0]
        return out
    # residual slope of the quadratic at ``out``
    residual = slope.copy()
    order = np.flatnonzero(live)
    for _ in range(20_000):
        most = 0.0
        for j in order:
            c = curve[j, j]
            if c <= 0:
                continue
            aim = out[j] - residual[j] / c
            new = np.sign(aim) * max(abs(aim) - absolute[j] / c, 0.0)
            move = new - out[j]
            if move:
                out[j] = new
                residual += curve[:, j] * move
                most = max(most, abs(move))
        if most <= 1e-14 * max(1.0, np.abs(out).max()):
            break
    return out


def _advance(problem: Problem, sums: np.ndarray, tolerance: float) -> None:
    """Judge the last step by the sums at the present weights and take the next one."""
    width = len(problem.weights)
    rows, loss = sums[0], sums[1]
    value = loss / rows + problem.penalty(problem.weights)
    if problem.origin is not None and value > problem.value + 1e-13 * max(1.0, abs(problem.value)):
        problem.halvings += 1
        if problem.halvings > HALVINGS:
            problem.weights = problem.origin
            problem.settle()
            return
        problem.weights = (problem.weights + problem.origin) / 2
        return
    if problem.origin is not None:
        problem.steps += 1
        moved = np.abs(problem.weights - problem.origin).max()
        if problem.steps in problem.limits:
            problem.at_limit[problem.steps] = problem.weights
        if moved <= tolerance * max(1.0, np.abs(problem.weights).max()) or (
            problem.steps >= max(problem.limits)
        ):
            problem.settle()
            return
    h = np.zeros((width, width))
    upper = np.triu_indices(width)
    h[upper] = sums[2 + width :] / rows
    h = h + np.triu(h, 1).T
    problem.value, problem.halvings = value, 0
    problem.origin = problem.weights
    problem.weights = _prox_step(h, sums[2 : 2 + width] / rows, problem)


def fit_penalties(
    df: DataFrame,
    penalties: dict[tuple[float, float], Sequence[int]],
    folds: Sequence[int],
    features: str = "features",
    label: str = "binaryLabel",
    fold_column: str | None = None,
    tolerance: float = TOLERANCE,
) -> dict[tuple[float, float, int, int], np.ndarray]:
    """(intercept, weights...) of every penalty, fold left out and iteration limit.

    Fold -1 leaves nothing out. Keep the table first where it is costly to read: it is scanned
    once per Newton step, about eight times.
    """
    fold = F.col(fold_column).cast("int") if fold_column else F.lit(0)
    if df.isEmpty():
        raise ValueError("no rows to fit on")
    rows = df.select(
        as_array(df, features).alias("x"), F.col(label).cast("double").alias("y"), fold.alias("fold")
    )
    width = len(rows.first()["x"])
    moments = _moments(rows, width)
    missing = [f for f in folds if f >= 0 and f not in moments]
    if missing:
        raise ValueError(f"no rows in folds {missing}")
    _, centre, square = _joined(list(moments.values()))
    count = sum(m[0] for m in moments.values())
    deviation = np.sqrt(square / count)
    deviation[deviation == 0] = 1.0
    problems = []
    for f in folds:
        others = [m for g, m in moments.items() if g != f]
        if not others:
            raise ValueError(f"no rows outside fold {f}")
        n, _, own = _joined(others)
        spread = np.sqrt(own / max(n - 1, 1))
        for (strength, share), limits in penalties.items():
            problem = Problem(strength, share if strength else 0.0, f, sorted(limits))
            problem.weights = np.zeros(width + 1)
            problem.live = spread > 0
            problem.scale = spread / deviation
            problems.append(problem)
    while open_ := [n for n, p in enumerate(problems) if not p.done]:
        # problems of one fold that stand at equal weights, as all do at first, share their sums
        places: dict[tuple[int, bytes], int] = {}
        of = {n: places.setdefault((problems[n].fold, (problems[n].weights + 0.0).tobytes()), n) for n in open_}
        asked = [(n, problems[n].fold, problems[n].weights) for n in places.values()]
        sums = rows.mapInArrow(_newton_sums(centre, deviation, asked), SUMS)
        # the sums of all problems are added place by place, combined before they move
        cells = sums.select("problem", F.posexplode("sums").alias("place", "part"))
        added = cells.groupBy("problem", "place").agg(F.sum("part").alias("sum"))
        table: dict[int, np.ndarray] = {}
        size = 3 + width + (width + 1) * (width + 2) // 2
        for row in added.collect():
            table.setdefault(row["problem"], np.zeros(size))[row["place"]] = row["sum"]
        for n in open_:
            _advance(problems[n], table[of[n]], tolerance)
    fitted = {}
    for p in problems:
        for limit, weights in p.at_limit.items():
            own = np.where(p.live, weights[1:], 0.0) / deviation
            intercept = weights[0] - float(own @ centre)
            fitted[p.strength, p.share, p.fold, limit] = np.r_[intercept, own]
    return fitted


def held_out_counts(
    df: DataFrame,
    fits: list[tuple[int, int, np.ndarray]],
    features: str,
    label: str,
    fold_column: str,
) -> DataFrame:
    """(segment, score, positives, negatives): scores of each fit (segment, fold, weights) on the
    rows of its fold, equal ones counted batch by batch."""
    by_fold: dict[int, tuple[list[int], np.ndarray]] = {}
    for f in sorted({f for _, f, _ in fits}):
        own = [(s, w) for s, g, w in fits if g == f]
        by_fold[f] = [s for s, _ in own], np.stack([w for _, w in own], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column("x")), numbers(batch.column("y")) > 0.5
            folds = batch.column("fold").to_numpy()
            found = []
            for f, (segments, weights) in by_fold.items():
                own = folds == f
                if not own.any():
                    continue
                scores, positive = x[own] @ weights[1:] + weights[0], y[own]
                for segment, column in zip(segments, scores.T):
                    # adding zero makes one score of both zeros
                    values, place = np.unique(column + 0.0, return_inverse=True)
                    positives = np.bincount(place[positive], minlength=len(values))
                    counts = np.bincount(place, minlength=len(values))
                    found.append((np.full(len(values), segment, np.int64), values, positives, counts - positives))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*found)],
                    names=["segment", "score", "positives", "negatives"],
                )

    rows = df.select(
        as_array(df, features).alias("x"),
        F.col(label).cast("double").alias("y"),
        F.col(fold_column).cast("int").alias("fold"),
    )
    return rows.mapInArrow(run, "segment long, score double, positives long, negatives long")


def cross_validate_penalties(
    df: DataFrame,
    points: list[dict],
    folds: int,
    features: str = "features",
    label: str = "binaryLabel",
    fold_column: str = "fold",
    max_iter: int = 100,
    tolerance: float = TOLERANCE,
    prefix: Sequence = (),
) -> DataFrame:
    """Cross-validated area under ROC of every grid point, with its rank.

    Points are dictionaries of regParam, elasticNetParam and maxIter. Points that cannot differ
    share a fit; all fits share the scans, and all areas one ranking. Stages of a ``prefix``
    are fitted on each fold's training rows, so each fold has scans of its own then.
    """

    def key(point: dict) -> tuple[float, float]:
        strength = float(point.get("regParam", 0.0))
        return strength, float(point.get("elasticNetParam", 0.0)) if strength else 0.0

    penalties: dict[tuple[float, float], set[int]] = {}
    for point in points:
        penalties.setdefault(key(point), set()).add(int(point.get("maxIter", max_iter)))
    tables = {}
    if prefix:
        fitted = {}
        for f in range(folds):
            train = df.where(F.col(fold_column) != f)
            before = Pipeline(stages=list(prefix)).fit(train)
            moved = before.transform(train)
            with kept(moved.select(as_array(moved, features).alias(features), label)) as moved:
                own = fit_penalties(moved, penalties, [-1], features, label, None, tolerance)
            fitted |= {(s, e, f, limit): w for (s, e, _, limit), w in own.items()}
            tables[f] = before.transform(df.where(F.col(fold_column) == f))
    else:
        fitted = fit_penalties(df, penalties, range(folds), features, label, fold_column, tolerance)
    # equal weights of one penalty and fold are ranked once
    fits, segment_of = [], {}
    for (strength, share, f, limit), weights in fitted.items():
        same = next(
            (s for s, g, w in fits if g == f and np.array_equal(w, weights)), None
        )
        segment = len(fits) if same is None else same
        if same is None:
            fits.append((segment, f, weights))
        segment_of[strength, share, f, limit] = segment
    if prefix:
        parts = [
            held_out_counts(t, [x for x in fits if x[1] == f], features, label, fold_column)
            for f, t in tables.items()
        ]
        scored = reduce(DataFrame.unionByName, parts)
    else:
        scored = held_out_counts(df, fits, features, label, fold_column)
    areas = {segment: area for segment, area, _ in areas_of_counts(scored)}
    rows = []
    for number, point in enumerate(points):
        strength, share = key(point)
        limit = int(point.get("maxIter", max_iter))
        values = [areas[segment_of[strength, share, f, limit]] for f in range(folds)]
        rows.append(
            (
                number,
                float(point.get("regParam", 0.0)),
                float(point.get("elasticNetParam", 0.0)),
                limit,
                sum(values) / len(values),
            )
        )
    table = df.sparkSession.createDataFrame(
        rows, "point int, reg_param double, elastic_net double, max_iter int, metric double"
    )
    # areas that differ by a few pairs of rows only are equal
    order = Window.orderBy(F.round("metric", 6).desc(), "point")
    return table.withColumn("rank", F.row_number().over(order))
