"""The end-to-end jobs: load, label, assemble, split, fit, evaluate, tune.

Each returns a :class:`JobResult`, whose report is a DataFrame of
(stage, metric, value, note) rows.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from contextlib import ExitStack
from dataclasses import dataclass, field

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlab.functions.activations import check_activation
from sensorlab.functions.labels import is_labelled
from sensorlab.operators import evaluate, linear, penalty_grid, tune
from sensorlab.operators.elm.model import (
    DEFAULT_ACTIVATION,
    DEFAULT_NODES,
    DEFAULT_TEST_FRACTION,
    NODE_LIMITS,
    ElmClassifier,
    score_activations,
    score_widths,
)
from sensorlab.operators.elm.layer import draw_layer
from sensorlab.operators.features import assemble
from sensorlab.operators.prepare import (
    hash_split,
    labelled,
    random_split,
    scale_symmetric,
    with_binary_label,
    with_fold,
    with_velocity,
)
from sensorlab.schema import (
    CHANNELS,
    ELM_FEATURES,
    GLM_FEATURES,
    LABEL,
    LOGISTIC_FEATURES,
    check_feature_columns,
)
from sensorlab.session import kept, remove_at_end, scratch_path
from sensorlab.sources.text import read_readings
from sensorlab.streaming.online import OnlineElm

REPORT = "stage string, metric string, value double, note string"

# The split seed of the jobs, and the range a job accepts for the
# held-out fraction (upper end excluded).
SPLIT_SEED = 12345
ELM_FRACTIONS = (0.1, 0.7)
LOGISTIC_FRACTIONS = (0.0, 0.7)


def _check_fraction(value: float, limits: tuple[float, float]) -> None:
    low, high = limits
    if not low <= value < high:
        raise ValueError(f"fracTest must be in [{low}, {high}), not {value}")


@dataclass(frozen=True)
class JobParams:
    """Options common to the jobs.

    ``key`` names a unique integer column; with it the split and folds are
    hashes of the key, else Spark's seeded random split.
    """

    features: Sequence[str] = tuple(ELM_FEATURES)
    scale: float = 1.0
    key: str | None = None
    tune: bool = True


@dataclass(frozen=True)
class ElmJobParams(JobParams):
    activationFunc: str = DEFAULT_ACTIVATION
    hiddenNodes: int = DEFAULT_NODES
    fracTest: float = DEFAULT_TEST_FRACTION
    init: str = "uniform"
    folds: int = tune.ELM_FOLDS
    #: Output above which class 1 is predicted, and grid points in place of the job's own.
    decisionThreshold: float = 0.0
    points: Sequence[tuple[str, int]] | None = None

    def __post_init__(self):
        check_activation(self.activationFunc)
        low, high = NODE_LIMITS
        if not low <= self.hiddenNodes <= high:
            raise ValueError(f"hiddenNodes must be between {low} and {high}")
        _check_fraction(self.fracTest, ELM_FRACTIONS)


@dataclass(frozen=True)
class LogisticJobParams(JobParams):
    features: Sequence[str] = tuple(LOGISTIC_FEATURES)
    fracTest: float = 0.5
    folds: int = tune.LOGISTIC_FOLDS
    grid: dict | None = None
    model: linear.LogisticParams = field(default_factory=linear.LogisticParams)

    def __post_init__(self):
        _check_fraction(self.fracTest, LOGISTIC_FRACTIONS)


@dataclass
class JobResult:
    """The report; the model of the training part; where tuned, the grid's
    metrics and the best point fitted on the data it was tuned on."""

    report: DataFrame
    model: Model
    grid: DataFrame | None = None
    best: Model | None = None


class _Report:
    def __init__(self):
        self.rows: list[tuple[str, str, float, str | None]] = []

    def add(self, stage: str, metric: str, value: float, note: str | None = None) -> None:
        self.rows.append((stage, metric, float(value), note))

    def timed(self, stage: str, metric: str, work):
        start = time.perf_counter()
        result = work()
        self.add(stage, metric, time.perf_counter() - start)
        return result

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, REPORT)


def load(spark: SparkSession, source: str | list[str] | DataFrame) -> DataFrame:
    """A file, several files, a folder, or a table already loaded."""
    return source if isinstance(source, DataFrame) else read_readings(spark, source)


def _training_frame(
    spark: SparkSession, source, params: JobParams, vector: bool
) -> DataFrame:
    """Labelled rows reduced to features, label and key.

    Arrays cross to Python at half the cost of vectors, so the network gets
    those; Spark's own estimators need vectors.
    """
    data = load(spark, source)
    check_feature_columns(params.features, data)
    rows = with_binary_label(labelled(data))
    scaled = [(F.col(c) / params.scale).alias(c) for c in params.features]
    rest = ["binaryLabel"] + ([params.key] if params.key else [])
    if vector:
        return assemble(rows.select(*scaled, *rest), params.features).select("features", *rest)
    return rows.select(F.array(*scaled).alias("features"), *rest)


def _split(df: DataFrame, params: JobParams, fraction: float):
    if params.key:
        return hash_split(df, params.key, fraction, SPLIT_SEED)
    return random_split(df, fraction, SPLIT_SEED)


def _evaluate(report: _Report, stage: str, model: Model, df: DataFrame) -> None:
    """Force and time the scoring, then both metrics of the same kept scores."""
    scored = model.transform(df)
    # scores are kept as numbers, not as vectors
    score = evaluate.score_column(scored, "rawPrediction").alias("score")
    predictions = scored.select("binaryLabel", score, "prediction")
    with kept(predictions):
        report.timed(
            stage,
            "prediction seconds",
            lambda: predictions.write.format("noop").mode("overwrite").save(),
        )
        report.add(stage, "auroc", evaluate.area_under(predictions, "score"))
        metrics = evaluate.error_metrics(predictions).first()
        report.add(stage, "misclassification", metrics["misclassification"])
        report.add(stage, "rows", metrics["rows"])


#: Bytes of a row group of stored rows: a scan holds one for every task, in the heap and beside it.
STORED_GROUP = 16 * 1024 * 1024


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows from files that are removed when the application ends.

    Rows of many channels outgrow an executor while Spark keeps them: beside what it counts as kept,
    each task holds the last hundred batches of 10,000 rows that it has written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(**{"compression": "zstd", "parquet.block.size": STORED_GROUP}).parquet(path)
    remove_at_end(spark, path)
    return spark.read.parquet(path)


def _folds(df: DataFrame, params: JobParams, folds: int) -> DataFrame:
    """A fold number on every row, the same in every scan.

    Without a key the numbers are random, so the rows are written once with
    them: a recomputed row could else stand in training and held-out parts.
    """
    if params.key:
        return with_fold(df, params.key, folds, seed=SPLIT_SEED)
    spark = df.sparkSession
    path = scratch_path(spark, "folds")
    df.withColumn("fold", F.floor(F.rand(SPLIT_SEED) * folds).cast("int")).write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.parquet(path)


def run_elm(
    spark: SparkSession, source, params: ElmJobParams = ElmJobParams()
) -> JobResult:
    """Train and evaluate a network; tune it on the held-out part."""
    report = _Report()
    with ExitStack() as scope:
        data = scope.enter_context(kept(_training_frame(spark, source, params, vector=False)))
        report.add("data", "samples", data.count())
        train, test = _split(data, params, params.fracTest)
        estimator = ElmClassifier(
            activationFunc=params.activationFunc,
            hiddenNodes=params.hiddenNodes,
            fracTest=params.fracTest,
            init=params.init,
            decisionThreshold=params.decisionThreshold,
        )
        model = report.timed("fit", "training seconds", lambda: estimator.fit(train))
        _evaluate(report, "train", model, train)
        _evaluate(report, "test", model, test)
        grid = best_model = None
        if params.tune:
            held = _folds(test, params, params.folds)
            points = params.points or tune.elm_grid_points(params.activationFunc, params.hiddenNodes)
            rows = report.timed(
                "tune",
                "cross-validation seconds",
                lambda: tune.elm_cross_validate(
                    held, points, params.folds, init=params.init, threshold=params.decisionThreshold
                ).collect(),
            )
            best = min(rows, key=lambda r: r["rank"])
            report.add("tune", "best hidden nodes", best["hidden_nodes"], best["activation"])
            report.add("tune", "best misclassification", best["error"])
            best_model = estimator.copy(
                {
                    estimator.activationFunc: best["activation"],
                    estimator.hiddenNodes: best["hidden_nodes"],
                }
            ).fit(held)
            _evaluate(report, "tuned", best_model, held)
            grid = spark.createDataFrame(rows)
    return JobResult(report.table(spark), model, grid, best_model)


#: Steps of the estimator that a refit may take for each Newton step of the grid's limit.
REFIT_STEPS = 10


def _tune_logistic(
    report: _Report,
    estimator,
    data: DataFrame,
    params: LogisticJobParams,
    prefix=(),
    moved: DataFrame | None = None,
) -> tuple[DataFrame, Model]:
    """Grid table, and the best point fitted on all the data it was tuned on; ``moved`` is that
    data behind the stages of the prefix, fitted on all of it."""
    held = _folds(data, params, params.folds)
    rows = report.timed(
        "tune",
        "cross-validation seconds",
        lambda: penalty_grid.cross_validate_penalties(
            held,
            tune.logistic_points(params.grid),
            params.folds,
            max_iter=params.model.maxIter,
            prefix=prefix,
        ).collect(),
    )
    best = min(rows, key=lambda r: r["rank"])
    settings = {
        "regParam": best["reg_param"],
        "elasticNetParam": best["elastic_net"],
        "maxIter": best["max_iter"],
    }
    report.add("tune", "best auroc", best["metric"], str(settings))
    # the grid counts Newton steps, each worth several of the estimator's
    settings["maxIter"] *= REFIT_STEPS
    chosen = estimator.copy({estimator.getParam(k): v for k, v in settings.items()})
    model = chosen.fit(data if moved is None else moved)
    return data.sparkSession.createDataFrame(rows), model


def run_logistic(
    spark: SparkSession, source, params: LogisticJobParams = LogisticJobParams()
) -> JobResult:
    """Train and evaluate a logistic regression; tune it on all data."""
    report = _Report()
    with kept(_training_frame(spark, source, params, vector=True)) as data:
        report.add("data", "samples", data.count())
        train, test = _split(data, params, params.fracTest)
        estimator = params.model.estimator()
        model = report.timed("fit", "training seconds", lambda: estimator.fit(train))
        for name, value in zip(params.features, model.coefficients):
            report.add("fit", "coefficient", value, name)
        report.add("fit", "intercept", model.intercept)
        _evaluate(report, "train", model, train)
        _evaluate(report, "test", model, test)
        grid = best = None
        if params.tune:
            grid, best = _tune_logistic(report, estimator, data, params)
            _evaluate(report, "tuned", best, data)
    return JobResult(report.table(spark), model, grid, best)


def run_pca_logistic(
    spark: SparkSession,
    source,
    params: LogisticJobParams = LogisticJobParams(features=tuple(CHANNELS)),
    k: int = 3,
) -> JobResult:
    """Logistic regression on the principal components of all channels; tuned
    on the training part."""
    report = _Report()
    data = load(spark, source)
    check_feature_columns(params.features, data)
    rest = ["binaryLabel"] + ([params.key] if params.key else [])
    assembler, *prefix, estimator = linear.pca_logistic(params.features, params.model, k).getStages()
    rows = assembler.transform(with_binary_label(labelled(data)).select(*params.features, *rest))
    # rows are assembled once, and both parts are projected once on the training part's components
    data = _stored(rows.select(assembler.getOutputCol(), *rest), "channels")
    report.add("data", "samples", data.count())
    train, test = _split(data, params, params.fracTest)

    def fit():
        before = Pipeline(stages=prefix).fit(train)
        moved = [
            _stored(before.transform(part).select("features", "binaryLabel"), "projected") for part in (train, test)
        ]
        return before, moved, estimator.fit(moved[0])

    before, (moved, held), last = report.timed("fit", "training seconds", fit)
    for i, share in enumerate(before.stages[0].explainedVariance.toArray()):
        report.add("fit", "explained variance", share, f"component {i + 1}")
    _evaluate(report, "train", last, moved)
    _evaluate(report, "test", last, held)
    grid = best = None
    if params.tune:
        grid, tuned = _tune_logistic(report, estimator, train, params, prefix, moved)
        _evaluate(report, "tuned", tuned, held)
        best = PipelineModel([assembler, *before.stages, tuned])
    model = PipelineModel([assembler, *before.stages, last])
    return JobResult(report.table(spark), model, grid, best)


# Layer width, activations and split of the exploration.
EXPLORE_NODES = 50
EXPLORE_ACTIVATIONS = ("sigmoid", "radbas")
EXPLORE_FRACTION = 0.5
ONLINE_NODES = (10, 40, 100)
ONLINE_BATCHES = 3

VELOCITIES = {
    "Velocity_Chest": CHANNELS[0:3],
    "Velocity_LAnkle": CHANNELS[5:8],
    "Velocity_Arm": CHANNELS[14:17],
}


def _explore_online(
    report: _Report,
    spark: SparkSession,
    data: DataFrame,
    scale: float,
    sizes: Sequence[int] = ONLINE_NODES,
    init: str = "uniform",
) -> None:
    """Networks trained online on channels, on velocities, and on velocities scaled to
    [-1, 1], and their training error and time, in several micro-batches of files.

    A micro-batch has many files, so that all tasks share it and none reads much of the table.
    A narrower network's layer is the first nodes of the widest one's, so one stream of each
    input trains all widths, exactly, and its seconds stand at each of them; the inputs are
    written once, side by side, and one scan scores all networks.
    """
    rows = with_velocity(with_binary_label(labelled(data)), VELOCITIES).select(
        "binaryLabel",
        F.array(*[F.col(c) / scale for c in CHANNELS[:3]]).alias("channels"),
        F.array(*VELOCITIES).alias("velocities"),
        *VELOCITIES,
    )
    rows = scale_symmetric(rows, list(VELOCITIES))
    rows = rows.select("binaryLabel", "channels", "velocities", F.array(*VELOCITIES).alias("scaled_velocities"))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(-(-shuffled // ONLINE_BATCHES), spark.sparkContext.defaultParallelism)
    folder = scratch_path(spark, "stream")
    rows.repartition(ONLINE_BATCHES * files).write.parquet(folder)
    remove_at_end(spark, folder)
    stored = spark.read.parquet(folder)
    layer = draw_layer(max(sizes), 3, "sigmoid", init)
    scores, keys = [], []
    for column in stored.columns[1:]:
        online = OnlineElm(spark, layer, scratch_path(spark, "online-state"), features=column)
        stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files).parquet(folder)
        checkpoint = scratch_path(spark, "online-checkpoint")
        for path in (online.state_path, checkpoint):
            remove_at_end(spark, path)
        stage = f"online {column.replace('_', ' ')}"
        start = time.perf_counter()
        online.start(stream, checkpoint).awaitTermination()
        seconds = time.perf_counter() - start
        for nodes in sizes:
            report.add(stage, "training seconds", seconds, f"{nodes} nodes")
        betas = {f"n{nodes}": online.model(nodes=nodes).beta for nodes in sizes}
        scores.append(score_widths(F.col(column), layer, betas).alias(column))
        keys += [(f"{column}.n{nodes}", stage, f"{nodes} nodes") for nodes in sizes]
    scored = stored.select("binaryLabel", *scores)
    cut = [(F.col(name) > 0.5).cast("double").alias(f"prediction_{i}") for i, (name, _, _) in enumerate(keys)]
    predicted = scored.select("binaryLabel", *cut)
    errors = evaluate.error_metrics_of(predicted, predicted.columns[1:]).collect()
    for metrics, (_, stage, note) in zip(errors, keys):
        report.add(stage, "rows", metrics["rows"], note)
        report.add(stage, "train error", metrics["misclassification"], note)


def run_online_exploration(
    spark: SparkSession, source, scale: float = 1.0, sizes: Sequence[int] = ONLINE_NODES, init: str = "uniform"
) -> DataFrame:
    """The online part of the exploration alone: its report."""
    report = _Report()
    _explore_online(report, spark, load(spark, source), scale, sizes, init)
    return report.table(spark)


def run_exploration(
    spark: SparkSession, source, params: JobParams = JobParams(), init: str = "uniform"
) -> JobResult:
    """Sizes, velocities, networks with a threshold sweep, online networks, and a binomial model.

    Test figures are those of the held-out rows, by the training part's
    extremes and best threshold.
    """
    report = _Report()
    data = load(spark, source)
    counts = with_velocity(data, VELOCITIES).agg(
        F.count("*").alias("all"),
        F.count_if(F.col(LABEL) == 0).alias("unlabelled"),
        F.count_if(F.col(LABEL) > 0).alias("labelled"),
        *[F.avg(F.when(is_labelled(), F.col(v))).alias(v) for v in VELOCITIES],
    ).first()
    for name in ("all", "unlabelled", "labelled"):
        report.add("data", f"{name} rows", counts[name])
    for name in VELOCITIES:
        report.add("data", "mean velocity", counts[name], name)

    with ExitStack() as scope:
        rows = scope.enter_context(kept(_training_frame(spark, data, params, vector=False)))
        train, test = _split(rows, params, EXPLORE_FRACTION)
        models = {}
        for name in EXPLORE_ACTIVATIONS:
            estimator = ElmClassifier(hiddenNodes=EXPLORE_NODES, activationFunc=name, init=init)
            models[name] = report.timed(name, "training seconds", lambda: estimator.fit(train))
        model = models[EXPLORE_ACTIVATIONS[-1]]
        # the networks have one layer, so one scan of either part scores both and its scores are kept
        outputs = score_activations(F.col("features"), model.layer, {n: m.beta for n, m in models.items()})
        scored, held = (
            scope.enter_context(kept(part.select("binaryLabel", outputs.alias("score")).select("binaryLabel", "score.*")))
            for part in (train, test)
        )
        ends = scored.agg(*[f(n).alias(f"{n}_{f.__name__}") for n in models for f in (F.min, F.max)]).first()
        for name in EXPLORE_ACTIVATIONS:
            low, high = ends[f"{name}_min"], ends[f"{name}_max"]
            normal = F.try_divide(F.col(name) - F.lit(low), F.lit(high - low)).alias("normal")
            sweep = evaluate.threshold_sweep(scored.select(normal, "binaryLabel"), "normal", "binaryLabel")
            best = evaluate.best_threshold(sweep).first()
            report.add(name, "best threshold", best["threshold"])
            report.add(name, "train accuracy", best["accuracy"])
            cut = evaluate.threshold_sweep(
                held.select(normal, "binaryLabel"), "normal", "binaryLabel", [best["threshold"]]
            ).first()
            report.add(name, "test accuracy", cut["accuracy"])

    _explore_online(report, spark, data, params.scale)

    five = JobParams(features=tuple(GLM_FEATURES), key=params.key, tune=False)
    with kept(_training_frame(spark, data, five, vector=True)) as rows:
        train, _ = _split(rows, params, EXPLORE_FRACTION)
        binomial = linear.fit_binomial(train)
        predicted = binomial.transform(train).withColumn(
            "prediction", (F.col("probability") > linear.GLM_CUT).cast("double")
        )
        error = evaluate.error_metrics(predicted).first()["misclassification"]
        report.add("binomial", "train error", error)
        report.add("binomial", "deviance", binomial.summary.deviance)
        for row in linear.summary_table(binomial, GLM_FEATURES, spark).collect():
            for metric in ("estimate", "std_error", "z", "p"):
                report.add("binomial", metric, row[metric], row["feature"])
    return JobResult(report.table(spark), model)
