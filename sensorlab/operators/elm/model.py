"""Extreme learning machine as pipeline stages: classifier and regressor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml.classification import ClassificationModel, Classifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasSeed
from pyspark.ml.regression import RegressionModel, Regressor
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlab.functions.activations import activate, activation, check_activation
from sensorlab.functions.arrow import matrix
from sensorlab.operators.elm.layer import INITS, Layer, draw_layer
from sensorlab.operators.elm.solver import RCOND, design_rows, gather, solve
from sensorlab.operators.features import as_array

# Production defaults and limits of the classifier's parameters.
DEFAULT_ACTIVATION = "tanh"
DEFAULT_NODES = 100
DEFAULT_TEST_FRACTION = 0.6
NODE_LIMITS = (10, 1000)
TEST_FRACTION_LIMITS = (0.10, 0.70)


def _within(low, high, convert, what):
    def check(value):
        value = convert(value)
        if not low <= value <= high:
            raise ValueError(f"{what} must be between {low} and {high}, not {value}")
        return value

    return check


def _activation(value):
    return check_activation(TypeConverters.toString(value))


def _init(value):
    if value not in INITS:
        raise ValueError(f"init must be one of {INITS}, not {value!r}")
    return value


class ElmParams(HasSeed):
    """Parameters shared by the estimators and their models."""

    activationFunc = Param(
        Params._dummy(),
        "activationFunc",
        "activation of the hidden nodes: sigmoid, tanh, sin, radbas or hardlim",
        _activation,
    )
    hiddenNodes = Param(
        Params._dummy(),
        "hiddenNodes",
        "number of hidden nodes, 10 to 1000",
        _within(*NODE_LIMITS, TypeConverters.toInt, "hiddenNodes"),
    )
    fracTest = Param(
        Params._dummy(),
        "fracTest",
        "fraction of the data a job holds out for testing, 0.10 to 0.70",
        _within(*TEST_FRACTION_LIMITS, TypeConverters.toFloat, "fracTest"),
    )
    init = Param(
        Params._dummy(), "init", "how the layer is drawn: uniform, normal or arithmetic", _init
    )
    rcond = Param(
        Params._dummy(),
        "rcond",
        "singular values below this fraction of the largest count as zero",
        TypeConverters.toFloat,
    )
    fitPartitions = Param(
        Params._dummy(),
        "fitPartitions",
        "spread the rows over this many tasks before the fit; 0 keeps the input's tasks",
        TypeConverters.toInt,
    )

    def _set_elm_defaults(self):
        self._setDefault(
            activationFunc=DEFAULT_ACTIVATION,
            hiddenNodes=DEFAULT_NODES,
            fracTest=DEFAULT_TEST_FRACTION,
            init="uniform",
            rcond=RCOND,
            fitPartitions=0,
            seed=12345,
        )

    def getActivationFunc(self) -> str:
        return self.getOrDefault(self.activationFunc)

    def getHiddenNodes(self) -> int:
        return self.getOrDefault(self.hiddenNodes)

    def getFracTest(self) -> float:
        return self.getOrDefault(self.fracTest)

    def getInit(self) -> str:
        return self.getOrDefault(self.init)

    def getRcond(self) -> float:
        return self.getOrDefault(self.rcond)

    def getFitPartitions(self) -> int:
        return self.getOrDefault(self.fitPartitions)


class _ElmSetters:
    def setActivationFunc(self, value: str):
        return self._set(activationFunc=value)

    def setHiddenNodes(self, value: int):
        return self._set(hiddenNodes=value)

    def setFracTest(self, value: float):
        return self._set(fracTest=value)

    def setInit(self, value: str):
        return self._set(init=value)

    def setRcond(self, value: float):
        return self._set(rcond=value)

    def setFitPartitions(self, value: int):
        return self._set(fitPartitions=value)

    def setSeed(self, value: int):
        return self._set(seed=value)


def vector_length(df: DataFrame, column: str) -> int:
    """Length of the vectors: from the column's metadata, else from the first row."""
    attributes = df.schema[column].metadata.get("ml_attr", {})
    if attributes.get("num_attrs"):
        return int(attributes["num_attrs"])
    first = df.select(F.size(as_array(df, column))).head()
    if first is None:
        raise ValueError("cannot fit on an empty table")
    return int(first[0])


def score_column(features: Column, layer: Layer, beta: np.ndarray) -> Column:
    """Network output per row: one matrix product per Arrow batch."""

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(layer.scores(matrix(x), beta))

    return score(features)


def score_expression(features: Column, layer: Layer, beta: np.ndarray) -> Column:
    """The same output as one expression over arrays of weights, without a Python worker.

    ``features`` is an array column. Nodes are a constant array of (bias, output weight, weights...)
    that one aggregate runs over, so a wide layer is no wider an expression than a narrow one.
    It stays inside the JVM; where Python workers are at hand, :func:`score_column`'s matrix
    products are faster for wide layers.
    """
    nodes = np.column_stack([layer.bias, beta, layer.weights]).tolist()

    def add(total: Column, node: Column) -> Column:
        terms = (node[j + 2] * features[j] for j in range(layer.features))
        z = sum(terms, node[0])
        # the weighted input stands once in each form, so it is worked out once
        out = F.exp(-F.pow(z, F.lit(2.0))) if layer.activation == "radbas" else activation(layer.activation, z)
        return total + node[1] * out

    return F.aggregate(F.lit(nodes), F.lit(0.0), add)


def score_activations(
    features: Column, layer: Layer, betas: dict[str, np.ndarray]
) -> Column:
    """Outputs under several activations of one layer, as a struct with a field
    per activation; the linear part is computed once."""
    names = list(betas)
    weights, bias = layer.weights, layer.bias

    @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in names) + ">")
    def score(x: pa.Array) -> pa.Array:
        z = matrix(x) @ weights.T + bias if len(x) else np.empty((0, len(bias)))
        return pa.StructArray.from_arrays(
            [pa.array(activate(n, z.copy()) @ betas[n]) for n in names], names=names
        )

    return score(features)


def score_widths(features: Column, layer: Layer, betas: dict[str, np.ndarray]) -> Column:
    """Outputs of networks made of the first nodes of one layer, as a struct with a field per
    network; the hidden outputs are computed once."""
    names = list(betas)
    weights = np.zeros((layer.nodes, len(names)))
    for i, name in enumerate(names):
        weights[: len(betas[name]), i] = betas[name]

    @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in names) + ">")
    def score(x: pa.Array) -> pa.Array:
        found = layer.scores(matrix(x), weights) if len(x) else np.empty((0, len(names)))
        return pa.StructArray.from_arrays([pa.array(column.copy()) for column in found.T], names=names)

    return score(features)


def _binary(layer: Layer):
    return lambda x: [layer.outputs(x)]


def _fit(estimator, dataset: DataFrame, binary: bool) -> tuple[Layer, np.ndarray]:
    features, label = estimator.getFeaturesCol(), estimator.getLabelCol()
    layer = draw_layer(
        estimator.getHiddenNodes(),
        vector_length(dataset, features),
        estimator.getActivationFunc(),
        estimator.getInit(),
        estimator.getSeed(),
    )
    rows = dataset.select(features, label)
    if binary:
        rows = rows.withColumn(label, _zero_or_one(label))
    if estimator.getFitPartitions():
        rows = rows.repartition(estimator.getFitPartitions())
    tasks = design_rows(rows, _binary(layer), features, label)
    factor = gather(tasks, layer.nodes + 1)[0]
    return layer, solve(factor, rcond=estimator.getRcond())


def _zero_or_one(label: str) -> Column:
    value = F.col(label).cast("double")
    return F.when(value.isin(0.0, 1.0), value).otherwise(
        F.raise_error(F.lit("labels must be 0 or 1")).cast("double")
    )


class _ElmWriter(MLWriter):
    """Parameters as metadata, one parquet row per hidden node."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        model = self.instance
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession)
        model.node_table(self.sparkSession).coalesce(1).write.parquet(f"{path}/nodes")


class _ElmReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/nodes").orderBy("node").collect()
        values = {**metadata["defaultParamMap"], **metadata["paramMap"]}
        layer = Layer(
            np.array([r["weights"] for r in rows]),
            np.array([r["bias"] for r in rows]),
            values["activationFunc"],
        )
        model = self.cls(layer, np.array([r["beta"] for r in rows]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _ElmModelParts(MLWritable, MLReadable):
    layer: Layer
    beta: np.ndarray

    @property
    def numFeatures(self) -> int:
        return self.layer.features

    def node_table(self, spark) -> DataFrame:
        """The model as rows (node, weights, bias, beta)."""
        rows = [
            (i, self.layer.weights[i].tolist(), float(self.layer.bias[i]), float(self.beta[i]))
            for i in range(self.layer.nodes)
        ]
        return spark.createDataFrame(
            rows, "node int, weights array<double>, bias double, beta double"
        )

    def output(self, features) -> float:
        row = np.asarray(features.toArray(), dtype=float)[None, :]
        return float(self.layer.scores(row, self.beta)[0])

    def score(self, df: DataFrame) -> Column:
        return score_column(as_array(df, self.getFeaturesCol()), self.layer, self.beta)

    def write(self) -> _ElmWriter:
        return _ElmWriter(self)

    @classmethod
    def read(cls) -> _ElmReader:
        return _ElmReader(cls)


class ElmClassifier(
    Classifier, ElmParams, _ElmSetters, DefaultParamsWritable, DefaultParamsReadable
):
    """Binary classifier: a random hidden layer and least-squares output weights.

    The fit is one scan of the table.  ``decisionThreshold`` belongs to the
    model: class 1 where the output exceeds it.  Its default of 0 is the
    arg-max of the raw prediction (-t, t); targets are 0 and 1, so 0.5 is the
    middle between them.
    """

    decisionThreshold = Param(
        Params._dummy(), "decisionThreshold", "class 1 above this output", TypeConverters.toFloat
    )

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol="features",
        labelCol="binaryLabel",
        predictionCol="prediction",
        rawPredictionCol="rawPrediction",
        activationFunc=DEFAULT_ACTIVATION,
        hiddenNodes=DEFAULT_NODES,
        fracTest=DEFAULT_TEST_FRACTION,
        init="uniform",
        rcond=RCOND,
        fitPartitions=0,
        seed=12345,
        decisionThreshold=0.0,
    ):
        super().__init__()
        self._set_elm_defaults()
        self._setDefault(labelCol="binaryLabel", decisionThreshold=0.0)
        self._set(**self._input_kwargs)

    def setDecisionThreshold(self, value: float):
        return self._set(decisionThreshold=value)

    def _fit(self, dataset: DataFrame) -> ElmClassificationModel:
        layer, beta = _fit(self, dataset, binary=True)
        model = ElmClassificationModel(layer, beta)
        model._resetUid(self.uid)
        return self._copyValues(model)


class ElmClassificationModel(_ElmModelParts, ClassificationModel, ElmParams):
    decisionThreshold = ElmClassifier.decisionThreshold

    def __init__(self, layer: Layer, beta: np.ndarray):
        super().__init__()
        self._set_elm_defaults()
        self._setDefault(labelCol="binaryLabel", decisionThreshold=0.0)
        self.layer = layer
        self.beta = beta

    @property
    def numClasses(self) -> int:
        return 2

    def setDecisionThreshold(self, value: float):
        return self._set(decisionThreshold=value)

    def predictRaw(self, value) -> DenseVector:
        t = self.output(value)
        return Vectors.dense(-t, t)

    def predict(self, value) -> float:
        return float(self.output(value) > self.getOrDefault(self.decisionThreshold))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = dataset.withColumn("_output", self.score(dataset))
        t = F.col("_output")
        raw, predicted = self.getRawPredictionCol(), self.getPredictionCol()
        added = {}
        if raw:
            added[raw] = array_to_vector(F.array(-t, t))
        if predicted:
            cut = F.lit(self.getOrDefault(self.decisionThreshold))
            added[predicted] = F.when(t > cut, F.lit(1.0)).otherwise(F.lit(0.0))
        return scored.withColumns(added).drop("_output")


class ElmRegressor(
    Regressor, ElmParams, _ElmSetters, DefaultParamsWritable, DefaultParamsReadable
):
    """The same network for a continuous target."""

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol="features",
        labelCol="label",
        predictionCol="prediction",
        activationFunc=DEFAULT_ACTIVATION,
        hiddenNodes=DEFAULT_NODES,
        init="uniform",
        rcond=RCOND,
        fitPartitions=0,
        seed=12345,
    ):
        super().__init__()
        self._set_elm_defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ElmRegressionModel:
        layer, beta = _fit(self, dataset, binary=False)
        model = ElmRegressionModel(layer, beta)
        model._resetUid(self.uid)
        return self._copyValues(model)


class ElmRegressionModel(_ElmModelParts, RegressionModel, ElmParams):
    def __init__(self, layer: Layer, beta: np.ndarray):
        super().__init__()
        self._set_elm_defaults()
        self.layer = layer
        self.beta = beta

    def predict(self, value) -> float:
        return self.output(value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getPredictionCol(), self.score(dataset))
