"""The random hidden layer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlab.functions.activations import activate, activation, check_activation
from sensorlab.functions.hashing import lattice

# The ways to draw a layer.
INITS = ("uniform", "normal", "arithmetic")

# Rows whose hidden outputs are held at once while scoring.
SCORE_ROWS = 2000


@dataclass(frozen=True)
class Layer:
    """Weights (nodes x features) and bias (nodes) with their activation."""

    weights: np.ndarray
    bias: np.ndarray
    activation: str

    @property
    def nodes(self) -> int:
        return self.weights.shape[0]

    @property
    def features(self) -> int:
        return self.weights.shape[1]

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Hidden outputs of a block of rows."""
        z = x @ self.weights.T
        z += self.bias
        return activate(self.activation, z)

    def scores(self, x: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Network outputs of a block of rows, a few rows at a time to stay in cache."""
        parts = [
            self.outputs(x[start : start + SCORE_ROWS]) @ beta
            for start in range(0, len(x), SCORE_ROWS)
        ]
        return np.concatenate(parts) if parts else np.empty((0, *beta.shape[1:]))

    def first(self, nodes: int) -> Layer:
        """The layer made of the first nodes only."""
        return Layer(self.weights[:nodes], self.bias[:nodes], self.activation)


def draw_layer(
    nodes: int, features: int, activation: str = "tanh", init: str = "uniform", seed: int = 12345
) -> Layer:
    """Draw a layer.

    Node by node, so that the first nodes of a wide layer are the narrower
    layer of the same seed.  ``arithmetic`` uses integer arithmetic only and
    can be repeated in SQL; it has no seed.
    """
    check_activation(activation)
    if init == "arithmetic":
        k = np.arange(nodes * (features + 1), dtype=np.int64).reshape(nodes, features + 1)
        values = lattice(k)
    elif init in INITS:
        rng = np.random.default_rng(seed)
        shape = (nodes, features + 1)
        values = rng.random(shape) if init == "uniform" else rng.standard_normal(shape)
    else:
        raise ValueError(f"init must be one of {INITS}, not {init!r}")
    return Layer(values[:, 1:].copy(), values[:, 0].copy(), activation)


def layer_table(spark: SparkSession, layer: Layer) -> DataFrame:
    """The layer as rows (node, weights, bias); its size does not depend on the data."""
    rows = [
        (node, layer.weights[node].tolist(), float(layer.bias[node]))
        for node in range(layer.nodes)
    ]
    return spark.createDataFrame(rows, "node int, weights array<double>, bias double")


def linear_columns(features: list[Column], layer: Layer) -> list[Column]:
    """Weighted input of each node as a column expression."""
    if len(features) != layer.features:
        raise ValueError(f"layer takes {layer.features} features, got {len(features)}")
    return [
        sum((F.lit(float(v)) * x for v, x in zip(w, features)), F.lit(float(b)))
        for w, b in zip(layer.weights, layer.bias)
    ]


def hidden_columns(features: list[Column], layer: Layer) -> list[Column]:
    """Output of each node as a column expression, for narrow layers kept in SQL."""
    return [activation(layer.activation, z) for z in linear_columns(features, layer)]
