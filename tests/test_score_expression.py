"""Network outputs as one expression equal the matrix products, without a Python worker."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlab.functions.activations import ACTIVATIONS
from sensorlab.operators.elm.layer import draw_layer
from sensorlab.operators.elm.model import score_column, score_expression


@pytest.mark.parametrize("name", ACTIVATIONS)
@pytest.mark.parametrize("nodes", [1, 1000])
def test_expression_equals_matrix_products(spark, name, nodes):
    rng = np.random.default_rng(7)
    rows = [(x.tolist(),) for x in rng.normal(size=(60, 3))]
    df = spark.createDataFrame(rows, "x array<double>").repartition(2)
    layer = draw_layer(nodes, 3, name)
    beta = rng.normal(size=nodes) / nodes
    scored = df.select(
        score_expression(F.col("x"), layer, beta).alias("a"), score_column(F.col("x"), layer, beta).alias("b")
    )
    found = np.array(scored.collect())
    assert np.allclose(found[:, 0], found[:, 1], atol=1e-12, rtol=0)
    alone = df.select(score_expression(F.col("x"), layer, beta))
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_null_vectors_give_null(spark):
    df = spark.createDataFrame([(None,), ([1.0, 2.0, 3.0],)], "x array<double>")
    found = df.select(score_expression(F.col("x"), draw_layer(5, 3), np.ones(5))).collect()
    assert [r[0] is None for r in found] == [True, False]
