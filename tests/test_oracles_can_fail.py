"""Queries must differ from their SQL where a fit, a projection or a split is wrong."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from check_oracles import compare, database
from sensorlab.operators import features, linear, penalty_grid, prepare
from sensorlab.operators.elm import model
from sensorlab.plans import all_queries, network_queries

QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return database(sf_dir)


def is_red(spark, connection, sf_dir, name):
    return not compare(spark, connection, QUERIES[name], ORACLES[name], sf_dir)[0]


@pytest.mark.parametrize("act, nodes", [("tanh", 100), ("sigmoid", 50)])
def test_a_wide_fit_of_low_rank_shows(spark, sf_dir, act, nodes):
    whole = network_queries.wide_check(spark, sf_dir, act, nodes).first()
    cut = network_queries.wide_check(spark, sf_dir, act, nodes, rcond=1e-4).first()
    assert whole["wide_leaves_less"] and not cut["wide_leaves_less"]
    assert whole["narrow"] == cut["narrow"]


@pytest.mark.parametrize("name", ["elm_normal_equations_vectors", "elm_regression_check"])
def test_a_fit_of_low_rank_shows(spark, connection, sf_dir, monkeypatch, name):
    assert not is_red(spark, connection, sf_dir, name)
    solve = model.solve
    monkeypatch.setattr(model, "solve", lambda factor, rcond: solve(factor, rcond=3e-2))
    assert is_red(spark, connection, sf_dir, name)


class _Turned:
    """A PCA whose components are turned by a random rotation."""

    def __init__(self, model, k):
        self.turn = np.linalg.qr(np.random.default_rng(0).normal(size=(k, k)))[0]
        self.model = model

    def transform(self, df):
        rows = self.model.transform(df)
        from pyspark.ml.functions import vector_to_array

        x = vector_to_array("pca")
        cells = [
            sum(x[i] * float(self.turn[i, j]) for i in range(len(self.turn)))
            for j in range(len(self.turn))
        ]
        return rows.withColumn("pca", array_to_vector(F.array(*cells)))


def test_a_rotation_shows(spark, connection, sf_dir, monkeypatch):
    assert not is_red(spark, connection, sf_dir, "pca_project")
    fit = features.fit_pca
    monkeypatch.setattr(features, "fit_pca", lambda df, k, *a: _Turned(fit(df, k, *a), k))
    assert is_red(spark, connection, sf_dir, "pca_project")


@pytest.mark.parametrize("threshold", [-100.0, 100.0])
def test_a_constant_prediction_shows(spark, connection, sf_dir, monkeypatch, threshold):
    """The right one is green in the tests of the queries."""
    params = network_queries.ElmJobParams
    monkeypatch.setattr(
        network_queries, "ElmJobParams", lambda **given: params(**{**given, "decisionThreshold": threshold})
    )
    assert is_red(spark, connection, sf_dir, "job_elm_signal")


def test_a_wider_network_shows(spark, connection, sf_dir, monkeypatch):
    params = network_queries.ElmJobParams
    monkeypatch.setattr(
        network_queries, "ElmJobParams", lambda **given: params(**{**given, "hiddenNodes": 100})
    )
    assert is_red(spark, connection, sf_dir, "job_elm_signal")


def test_a_wrong_grid_shows(spark, connection, sf_dir, monkeypatch):
    """Points with absolute penalties that get the weights of the squared one."""
    fit = penalty_grid.fit_penalties

    def without_lasso(*given):
        found = fit(*given)
        return {(s, e, f, n): found[s, 0.0, f, n] for s, e, f, n in found}

    monkeypatch.setattr(penalty_grid, "fit_penalties", without_lasso)
    assert is_red(spark, connection, sf_dir, "logistic_grid_points")


def test_an_empty_split_shows(spark, connection, sf_dir, monkeypatch):
    assert not is_red(spark, connection, sf_dir, "random_split")
    monkeypatch.setattr(
        prepare, "random_split", lambda df, fraction, *a: (df, df.where(F.lit(False)))
    )
    assert is_red(spark, connection, sf_dir, "random_split")


def test_a_wrong_inverse_shows(spark, connection, sf_dir, monkeypatch):
    rebuilt = network_queries.row_product
    monkeypatch.setattr(
        network_queries, "row_product", lambda x, m: rebuilt(x, m * (1 - 1e-5))
    )
    assert is_red(spark, connection, sf_dir, "svd_reconstruction")


def test_summary_p_values(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)]
    df = features.assemble(spark.createDataFrame(rows, "a double, b double, binaryLabel double"), ["a", "b"])
    table = {r["feature"]: r for r in linear.summary_table(linear.fit_binomial(df), ["a", "b"], spark).collect()}
    from math import erfc, sqrt

    for row in table.values():
        assert np.isclose(row["z"], row["estimate"] / row["std_error"])
        assert np.isclose(row["p"], erfc(abs(row["z"]) / sqrt(2)), atol=1e-8)
    assert table["a"]["p"] < 1e-6 < table["b"]["p"]
