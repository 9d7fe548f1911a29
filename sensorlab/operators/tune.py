"""Grid search with cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlab.functions.arrow import matrix, numbers
from sensorlab.operators.elm.layer import Layer, draw_layer
from sensorlab.operators.elm.model import vector_length
from sensorlab.operators.elm.solver import (
    RCOND,
    design_rows,
    fold,
    gather,
    solve,
)
from sensorlab.operators.evaluate import area_under_roc
from sensorlab.operators.features import as_array
from sensorlab.session import kept

# Grids and fold counts of the classifier jobs.
ELM_GRID_ACTIVATIONS = ["tanh", "sin"]
ELM_GRID_NODES = [10, 100, 150]
ELM_FOLDS = 3
LOGISTIC_GRID = {
    "regParam": [0.0, 0.01, 0.1],
    "maxIter": [10, 50, 100],
    "elasticNetParam": [0.0, 0.5, 1.0],
}
LOGISTIC_FOLDS = 5


def elm_grid_points(activation: str = "tanh", nodes: int = 100) -> list[tuple[str, int]]:
    """Distinct grid points of the job: its own settings and the fixed ones."""
    activations = dict.fromkeys([activation, *ELM_GRID_ACTIVATIONS])
    sizes = dict.fromkeys([ELM_GRID_NODES[0], nodes, *ELM_GRID_NODES[1:]])
    return [(a, n) for a in activations for n in sizes]


def _count_errors(
    layers: list[Layer],
    betas: dict[int, list[np.ndarray]],
    points: list[list[int]],
    threshold: float,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task, the wrong predictions of every grid point on every fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column("x")), numbers(batch.column("y"))
            folds = batch.column("fold").to_numpy()
            present = np.unique(folds).tolist()
            for i, layer in enumerate(layers):
                h = layer.outputs(x)
                for f in present:
                    held = folds == f
                    wrong = (h[held] @ betas[f][i] > threshold) != (y[held, None] > 0.5)
                    for point, count in zip(points[i], wrong.sum(axis=0).tolist()):
                        total = totals.setdefault((point, f), [0, 0])
                        total[0] += count
                        total[1] += int(held.sum())
        keys = list(totals)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int32()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([totals[k][0] for k in keys], pa.int64()),
                pa.array([totals[k][1] for k in keys], pa.int64()),
            ],
            names=["point", "fold", "wrong", "rows"],
        )

    return run


def elm_cross_validate(
    df: DataFrame,
    points: Sequence[tuple[str, int]],
    folds: int = ELM_FOLDS,
    features: str = "features",
    label: str = "binaryLabel",
    fold_column: str = "fold",
    init: str = "uniform",
    seed: int = 12345,
    threshold: float = 0.0,
    rcond: float = RCOND,
) -> DataFrame:
    """Cross-validated misclassification of each (activation, nodes) point.

    Two scans, whatever the size of the grid.  The first leaves one factor per
    fold and activation, for the widest layer; a training set is the other
    folds' factors stacked, and a narrower layer is the first columns of the
    wider one.  The second counts the errors of all points on the held-out rows.
    """
    points = list(dict.fromkeys(points))
    activations = list(dict.fromkeys(a for a, _ in points))
    count = vector_length(df, features)
    layers = [
        draw_layer(max(n for a, n in points if a == name), count, name, init, seed)
        for name in activations
    ]
    blocks = len(layers)
    widest = max(layer.nodes for layer in layers) + 1
    tasks = design_rows(
        df, lambda x: [layer.outputs(x) for layer in layers], features, label, fold_column, blocks
    )
    factors = gather(tasks, widest, folds * blocks)
    missing = [f for f in range(folds) if f * blocks not in factors]
    if missing:
        raise ValueError(f"no rows in folds {missing}")

    betas: dict[int, list[np.ndarray]] = {}
    numbers_by_layer = [[p for p, (a, _) in enumerate(points) if a == n] for n in activations]
    for f in range(folds):
        betas[f] = []
        for i, layer in enumerate(layers):
            others = [factors[g * blocks + i] for g in range(folds) if g != f]
            train = fold(None, np.vstack(others))
            columns = np.zeros((layer.nodes, len(numbers_by_layer[i])))
            for c, p in enumerate(numbers_by_layer[i]):
                nodes = points[p][1]
                columns[:nodes, c] = solve(train, nodes, rcond)
            betas[f].append(columns)

    rows = df.select(
        as_array(df, features).alias("x"),
        F.col(label).cast("double").alias("y"),
        F.col(fold_column).cast("int").alias("fold"),
    )
    counted = (
        rows.mapInArrow(
            _count_errors(layers, betas, numbers_by_layer, threshold),
            "point int, fold int, wrong bigint, rows bigint",
        )
        .groupBy("point", "fold")
        .agg(F.sum("wrong").alias("wrong"), F.sum("rows").alias("rows"))
    )
    names = df.sparkSession.createDataFrame(
        [(p, a, n) for p, (a, n) in enumerate(points)],
        "point int, activation string, hidden_nodes int",
    )
    metric = counted.groupBy("point").agg(
        F.avg(F.col("wrong") / F.col("rows")).alias("error"), F.sum("rows").alias("rows")
    )
    # one row per grid point from here on
    # errors that differ by the order of summing only are equal
    order = Window.orderBy(F.round("error", 12), "point")
    return names.join(metric, "point").withColumn("rank", F.row_number().over(order))


def cross_validate(
    estimator: Estimator,
    grid: list,
    evaluator: Evaluator,
    df: DataFrame,
    folds: int,
    fold_column: str | None = None,
    parallelism: int = 4,
    seed: int = 12345,
) -> CrossValidatorModel:
    """Spark's cross-validation of any estimator; with a fold column the folds
    do not depend on how the table is partitioned."""
    validator = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=evaluator,
        numFolds=folds,
        parallelism=parallelism,
        seed=seed,
    )
    if fold_column:
        validator.setFoldCol(fold_column)
    return validator.fit(df)


def logistic_points(grid: dict[str, list] | None = None) -> list[dict]:
    """All points of a logistic grid, the last parameter varying fastest."""
    grid = grid or LOGISTIC_GRID
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _penalty(point: dict) -> tuple[float, float]:
    """Penalty and elastic net share; the share means nothing without a penalty."""
    strength = point.get("regParam", 0.0)
    return strength, point.get("elasticNetParam", 0.0) if strength else 0.0


def logistic_cross_validate(
    df: DataFrame,
    estimator: LogisticRegression,
    folds: int = LOGISTIC_FOLDS,
    grid: dict[str, list] | None = None,
    fold_column: str = "fold",
    prefix: Sequence = (),
    parallelism: int = 4,
) -> DataFrame:
    """Cross-validated area under ROC of each grid point, with its rank.

    Gives what a cross-validator gives for the whole grid, with fewer fits:

    * stages before the estimator do not depend on the grid; they are fitted
      once per fold,
    * points without penalty that differ in the elastic net share are one point,
    * a fit that converged before its iteration limit is also the fit of every
      higher limit.

    Each fold's training and held-out rows are kept once while its points are
    fitted on them, ``parallelism`` at a time.
    """
    points = logistic_points(grid)
    chains: dict[tuple[float, float], list[int]] = {}
    for point in points:
        limits = chains.setdefault(_penalty(point), [])
        limit = point.get("maxIter", estimator.getMaxIter())
        if limit not in limits:
            limits.append(limit)
    def run(work):
        (strength, share), train, held = work
        metrics, metric = {}, None
        reached = previous = 0
        for limit in sorted(chains[strength, share]):
            if reached >= previous:
                settings = {"regParam": strength, "elasticNetParam": share, "maxIter": limit}
                model = estimator.copy(
                    {estimator.getParam(name): value for name, value in settings.items()}
                ).fit(train)
                reached = model.summary.totalIterations
                metric = area_under_roc(
                    model.transform(held),
                    estimator.getRawPredictionCol(),
                    estimator.getLabelCol(),
                )
            metrics[limit], previous = metric, limit
        return metrics

    inherit = inheritable_thread_target(df.sparkSession)
    totals: dict[tuple[tuple[float, float], int], list[float]] = {}
    with ThreadPool(min(parallelism, len(chains))) as pool:
        for f in range(folds):
            train = df.where(F.col(fold_column) != f)
            held = df.where(F.col(fold_column) == f)
            if prefix:
                before = Pipeline(stages=list(prefix)).fit(train)
                train, held = before.transform(train), before.transform(held)
            with kept(train) as train, kept(held) as held:
                work = [(key, train, held) for key in chains]
                for key, metrics in zip(chains, pool.map(inherit(run), work)):
                    for limit, metric in metrics.items():
                        totals.setdefault((key, limit), []).append(metric)

    rows = []
    for number, point in enumerate(points):
        limit = point.get("maxIter", estimator.getMaxIter())
        values = totals[_penalty(point), limit]
        strength, share = point.get("regParam", 0.0), point.get("elasticNetParam", 0.0)
        rows.append((number, float(strength), float(share), limit, sum(values) / len(values)))
    table = df.sparkSession.createDataFrame(
        rows, "point int, reg_param double, elastic_net double, max_iter int, metric double"
    )
    order = Window.orderBy(F.round("metric", 12).desc(), "point")
    return table.withColumn("rank", F.row_number().over(order))


def grid_report(model: CrossValidatorModel, spark) -> DataFrame:
    """One row per grid point: its parameters, average metric and rank."""
    better = model.getEvaluator().isLargerBetter()
    rows = [
        (i, {p.name: str(v) for p, v in point.items()}, float(metric))
        for i, (point, metric) in enumerate(
            zip(model.getEstimatorParamMaps(), model.avgMetrics, strict=True)
        )
    ]
    table = spark.createDataFrame(rows, "point int, params map<string,string>, metric double")
    key = F.col("metric").desc() if better else F.col("metric").asc()
    return table.withColumn("rank", F.row_number().over(Window.orderBy(key, "point")))
