"""Components and binomial models by triangular factors; recordings with an account of bad records."""

import numpy as np
import pytest
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from sensorlab.operators import binomial, components
from sensorlab.operators.features import assemble
from sensorlab.schema import CHANNELS, LABEL
from sensorlab.sources import text
from tests.conftest import reading_lines


def table(spark, x, y=None):
    rows = [(list(map(float, a)), float(b)) for a, b in zip(x, y if y is not None else np.zeros(len(x)))]
    return spark.createDataFrame(rows, "features array<double>, binaryLabel double").repartition(5)


@pytest.mark.parametrize("condition", [1e2, 1e6, 1e10])
def test_small_components_keep_their_digits(spark, condition):
    rng = np.random.default_rng(3)
    n, width = 3000, 6
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    base = np.linalg.qr(rng.normal(size=(n, width)) - 0)[0]
    base -= base.mean(axis=0)
    base = np.linalg.qr(base)[0]
    spread = np.geomspace(1, 1 / condition, width)
    x = (base * spread * np.sqrt(n - 1)) @ turn.T + rng.normal(size=width)
    found = components.fit_components(table(spark, x))
    assert np.allclose(np.sqrt(found.variances), spread, rtol=3e-6 if condition > 1e8 else 1e-9)
    assert found.rows == n and np.allclose(found.mean, x.mean(axis=0), atol=1e-9)
    assert np.allclose(np.abs(np.sum(found.axes * turn, axis=0)), 1, atol=1e-6)


def test_wide_and_far_components(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 1000)) * np.linspace(1, 3, 1000) + 1e6
    found = components.fit_components(table(spark, x))
    size = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / 1499
    assert np.allclose(found.variances, size, rtol=1e-6, atol=1e-6)
    assert np.isclose(found.shares.sum(), 1)


def test_projection_and_faults(spark):
    x = np.random.default_rng(6).normal(size=(200, 4)) * [4, 3, 2, 1] + 5
    df = table(spark, x)
    found = components.fit_components(df)
    got = np.array([r["components"] for r in found.project(df, 2, centred=True).select("components").collect()])
    wanted = (x - x.mean(axis=0)) @ found.axes[:, :2]
    assert np.allclose(np.sort(got, axis=0), np.sort(wanted, axis=0))
    plan = found.project(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for few in (df.limit(0), df.limit(1)):
        with pytest.raises(ValueError, match="two rows"):
            components.fit_components(few)
    with pytest.raises(Exception, match="null"):
        components.fit_components(df.unionByName(spark.createDataFrame([(None, 0.0)], df.schema)))
    same = components.fit_components(table(spark, np.ones((50, 3))))
    assert np.allclose(same.variances, 0) and np.allclose(same.shares, 0)


def test_binomial_equals_the_estimator(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 3)) * [1, 50, 0.02] + [0, 1000, 0]
    y = (rng.random(1200) < 1 / (1 + np.exp(-(x[:, 0] - 0.02 * (x[:, 1] - 1000) + 20 * x[:, 2])))).astype(float)
    df = table(spark, x, y).persist()
    own = binomial.fit_binomial_factor(df, tol=1e-12)
    rows = assemble(df.select("binaryLabel", *[F.col("features")[i].alias(f"x{i}") for i in range(3)]), ["x0", "x1", "x2"])
    theirs = GeneralizedLinearRegression(family="binomial", labelCol="binaryLabel", tol=1e-12).fit(rows)
    found = theirs.summary
    assert np.allclose(own.coefficients, [theirs.intercept, *theirs.coefficients], rtol=1e-6)
    # Spark lists the intercept's last
    errors = found.coefficientStandardErrors
    assert np.allclose(own.errors, [errors[-1], *errors[:-1]], rtol=1e-6)
    assert np.allclose(own.p, [found.pValues[-1], *found.pValues[:-1]], atol=1e-9)
    assert np.isclose(own.deviance, found.deviance) and np.isclose(own.null_deviance, found.nullDeviance)
    assert np.isclose(own.aic, found.aic)
    values = {(r["section"], r["name"]): r["value"] for r in own.summary(df, ["x0", "x1", "x2"]).collect()}
    residuals = sorted(r[0] for r in found.residuals("deviance").collect())
    for name, q in binomial.QUANTILES.items():
        assert np.isclose(values["residual", name], residuals[max(int(np.ceil(q * 1200)) - 1, 0)], atol=1e-6)
    assert values["fit", "residual freedom"] == 1196


def test_binomial_faults(spark):
    x = np.random.default_rng(1).normal(size=(60, 2))
    y = (x[:, 0] + np.random.default_rng(2).normal(size=60) > 0).astype(float)
    with pytest.raises(ValueError, match="dependent"):
        binomial.fit_binomial_factor(table(spark, np.column_stack([x, x[:, 0] * 2]), y))
    with pytest.raises(ValueError, match="empty"):
        binomial.fit_binomial_factor(table(spark, x, y).limit(0))
    with pytest.raises(Exception, match="neither 0 nor 1"):
        binomial.fit_binomial_factor(table(spark, x, y + 1))


@pytest.fixture
def faulty(tmp_path):
    folder = tmp_path / "faulty"
    folder.mkdir()
    first, second = reading_lines(40, 1), reading_lines(30, 2)
    first[3] = "1\t2\t3"
    first[10] = first[10].replace(first[10].split("\t")[5], "abc")
    second[0] = ""
    second[29] += "\tsurplus"
    (folder / "a.txt").write_text("\n".join(first) + "\n")
    (folder / "b.txt").write_text("\n".join(second) + "\n")
    return folder


def test_account_of_bad_records(spark, faulty):
    found = text.read_accounted(spark, str(faulty))
    assert found.counts == {"lines": 70, "accepted": 67, "short": 2, "not a number": 1}
    rejects = sorted(
        (r["file_path"].rsplit("/", 1)[1], r["reading_no"], r["reason"]) for r in found.rejects.collect()
    )
    assert rejects == [("a.txt", 4, "short"), ("a.txt", 11, "not a number"), ("b.txt", 1, "short")]
    assert found.readings.count() == 67 and found.reconciled()
    assert found.readings.columns == ["file_path", "reading_no", *CHANNELS, LABEL]
    numbers = [r[0] for r in found.readings.where("file_path LIKE '%b.txt'").select("reading_no").collect()]
    assert sorted(numbers) == list(range(2, 31))
    values = {r["value"] for r in found.rejects.collect()}
    assert "1\t2\t3" in values and "" in values


def test_account_of_good_and_empty_recordings(spark, recording, tmp_path):
    good = text.read_accounted(spark, str(recording))
    assert good.counts["accepted"] == 93 and good.rejects.count() == 0 and good.reconciled()
    wanted = text.read_readings(spark, str(recording))
    assert sorted(good.readings.select(*CHANNELS, LABEL).collect()) == sorted(wanted.collect())
    (tmp_path / "none.txt").write_text("")
    none = text.read_accounted(spark, str(tmp_path / "none.txt"))
    assert none.counts["lines"] == 0 and none.readings.count() == 0 and none.reconciled()


def test_strict_reading_converts_once(spark, faulty, recording):
    df = text.read_readings(spark, str(recording))
    plan = df._jdf.queryExecution().executedPlan().toString()
    conversions = [line for line in plan.split("\n") if "try_cast" in line]
    assert len(conversions) == 1 and "Generate inline" in conversions[0]
    assert df.count() == 93
    for columns in ([], [LABEL], CHANNELS):
        with pytest.raises(Exception, match="short or holds no number"):
            text.read_readings(spark, str(faulty)).select(*columns).write.format("noop").mode("overwrite").save()
