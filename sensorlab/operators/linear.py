"""Logistic and binomial models, plain or on principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.regression import (
    GeneralizedLinearRegression,
    GeneralizedLinearRegressionModel,
)
from pyspark.sql import DataFrame

# Fixed value: probability above which the binomial model predicts class 1.
GLM_CUT = 0.4


@dataclass(frozen=True)
class LogisticParams:
    """Defaults of the logistic job."""

    regParam: float = 0.0
    elasticNetParam: float = 0.0
    maxIter: int = 100
    fitIntercept: bool = True
    tol: float = 1e-6

    def estimator(self, features: str = "features", label: str = "binaryLabel"):
        return LogisticRegression(
            featuresCol=features,
            labelCol=label,
            regParam=self.regParam,
            elasticNetParam=self.elasticNetParam,
            maxIter=self.maxIter,
            fitIntercept=self.fitIntercept,
            tol=self.tol,
        )


def coefficient_table(model, names: Sequence[str], spark) -> DataFrame:
    """Coefficients and intercept of a fitted model as (feature, coefficient)."""
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients.toArray(), strict=True)]
    rows.append(("(intercept)", float(model.intercept)))
    return spark.createDataFrame(rows, "feature string, coefficient double")


def fit_logistic(
    df: DataFrame,
    params: LogisticParams = LogisticParams(),
    features: str = "features",
    label: str = "binaryLabel",
) -> LogisticRegressionModel:
    return params.estimator(features, label).fit(df)


def fit_binomial(
    df: DataFrame, features: str = "features", label: str = "binaryLabel", tol: float = 1e-6
) -> GeneralizedLinearRegressionModel:
    """Binomial model with logit link; ``model.summary`` has errors and deviance."""
    return GeneralizedLinearRegression(
        family="binomial",
        link="logit",
        featuresCol=features,
        labelCol=label,
        predictionCol="probability",
        tol=tol,
    ).fit(df)


def summary_table(
    model: GeneralizedLinearRegressionModel, names: Sequence[str], spark
) -> DataFrame:
    """Estimate, standard error, z and p of every coefficient, the intercept last."""
    found = model.summary
    estimates = [*model.coefficients.toArray().tolist(), model.intercept]
    rows = zip(
        [*names, "(intercept)"],
        estimates,
        found.coefficientStandardErrors,
        found.tValues,
        found.pValues,
        strict=True,
    )
    return spark.createDataFrame(
        [(name, *map(float, values)) for name, *values in rows],
        "feature string, estimate double, std_error double, z double, p double",
    )


def pca_logistic(
    channels: Sequence[str], params: LogisticParams = LogisticParams(), k: int = 3
) -> Pipeline:
    """Assemble channels, project on ``k`` components, classify."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(channels), outputCol="channels"),
            PCA(k=k, inputCol="channels", outputCol="features"),
            params.estimator(),
        ]
    )
