"""Hidden-node activations, as column expressions and as array functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The names a classifier accepts, and the further ones the
# exploration scripts use.
CLASSIFIER_ACTIVATIONS = ("sigmoid", "tanh", "sin")
ACTIVATIONS = CLASSIFIER_ACTIVATIONS + ("radbas", "hardlim")


def check_activation(name: str) -> str:
    if name not in ACTIVATIONS:
        raise ValueError(f"Activation function must be one of {ACTIVATIONS}, not {name!r}")
    return name


def activation(name: str, z: Column) -> Column:
    check_activation(name)
    if name == "sigmoid":
        return 1.0 / (1.0 + F.exp(-z))
    if name == "tanh":
        return F.tanh(z)
    if name == "sin":
        return F.sin(z)
    if name == "radbas":
        return F.exp(-(z * z))
    return F.when(z >= 0, F.lit(1.0)).otherwise(F.lit(0.0))


def activate(name: str, z: np.ndarray) -> np.ndarray:
    """The same on an array, which may be overwritten."""
    if name == "tanh":
        return np.tanh(z, out=z)
    if name == "sin":
        return np.sin(z, out=z)
    if name == "sigmoid":
        # tanh form: no overflow at either end
        z *= 0.5
        np.tanh(z, out=z)
        z += 1.0
        z *= 0.5
        return z
    if name == "radbas":
        np.multiply(z, z, out=z)
        np.negative(z, out=z)
        return np.exp(z, out=z)
    if name == "hardlim":
        return (z >= 0).astype(np.float64)
    raise ValueError(name)
