import pathlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from sensorlab.operators import evaluate, features, linear, prepare, tune
from sensorlab.operators.elm.model import ElmClassifier
from sensorlab.plans import jobs
from sensorlab.schema import CHANNELS, CHEST, GLM_FEATURES, LABEL, LOGISTIC_FEATURES
from sensorlab.session import scratch_path
from sensorlab.sources.text import to_parquet
from sensorlab.streaming.online import OnlineElm


@pytest.fixture(scope="module")
def data(signal):
    rows = prepare.with_binary_label(prepare.labelled(signal))
    return features.assemble(rows, LOGISTIC_FEATURES).persist()


def brute_area(scores, labels):
    wins = [(p > n) + 0.5 * (p == n) for p in scores[labels == 1] for n in scores[labels == 0]]
    return float(np.mean(wins))


def test_area_under_roc(spark):
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 30, 200).astype(float)
    labels = (rng.random(200) < 0.4).astype(float)
    df = spark.createDataFrame(
        [(float(s), float(y)) for s, y in zip(scores, labels)], "score double, binaryLabel double"
    )
    area = evaluate.area_under(df, "score")
    assert np.isclose(area, brute_area(scores, labels))
    squeezed = df.withColumn("score", F.tanh(F.col("score") / 40) * 3)
    assert np.isclose(evaluate.area_under(squeezed, "score"), area)
    assert np.isclose(evaluate.area_under(df.repartition(11), "score"), area)
    spark_area = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="binaryLabel", numBins=0
    )
    assert np.isclose(spark_area.evaluate(df), area)
    for one_class in (0.0, 1.0):
        part = df.where(F.col("binaryLabel") == one_class)
        assert evaluate.area_under(part, "score") == spark_area.evaluate(part) == one_class
    with pytest.raises(ValueError, match="no rows"):
        evaluate.area_under(df.limit(0), "score")
    perfect = df.withColumn("score", F.col("binaryLabel"))
    assert evaluate.area_under(perfect, "score", metric="areaUnderPR") == 1.0


def test_area_of_many_scores_and_one_hot_score(spark):
    rng = np.random.default_rng(6)
    scores = rng.normal(size=30_000)
    scores[rng.random(30_000) < 0.34] = 0.25
    labels = (rng.random(30_000) < 1 / (1 + np.exp(-scores))).astype(float)
    df = spark.createDataFrame(
        [(float(s), float(y)) for s, y in zip(scores, labels)], "score double, binaryLabel double"
    ).repartition(6)
    exact = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="binaryLabel", numBins=0
    ).evaluate(df)
    assert np.isclose(evaluate.AreaUnderRocEvaluator(rawPredictionCol="score").evaluate(df), exact)
    assert evaluate.AreaUnderRocEvaluator().isLargerBetter()


def test_error_metrics(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)], "prediction double, binaryLabel double"
    )
    assert tuple(evaluate.error_metrics(df).first()) == (2.0, 4, 0.5)
    assert len(evaluate.confusion_counts(df).collect()) == 4
    broken = {r["squared_diff"]: (r["total"], r["rows"]) for r in evaluate.error_breakdown(df).collect()}
    assert broken == {0.0: (0.0, 2), 1.0: (2.0, 2)}
    evaluator = evaluate.MisclassificationEvaluator()
    assert evaluator.evaluate(df) == 0.5 and not evaluator.isLargerBetter()
    with pytest.raises(PySparkException, match="no rows"):
        evaluator.evaluate(df.limit(0))


def test_threshold_sweep(spark):
    rng = np.random.default_rng(2)
    s, y = rng.random(500), (rng.random(500) < 0.5).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y)], "s double, y double")
    sweep = evaluate.threshold_sweep(df, "s", "y")
    got = {r["step"]: r["error"] for r in sweep.collect()}
    expected = {i: float(np.mean((s > 0.05 * i) != y)) for i in range(1, 21)}
    assert got == pytest.approx(expected)
    odd = evaluate.threshold_sweep(df, "s", "y", [0.7, 0.2, 0.7]).collect()
    assert [r["error"] for r in odd] == pytest.approx(
        [float(np.mean((s > t) != y)) for t in (0.7, 0.2, 0.7)]
    )
    best = evaluate.best_threshold(sweep).first()
    assert best["step"] == min(expected, key=lambda i: (round(expected[i], 12), i))
    plan = sweep._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_logistic_equals_binomial(data):
    logistic = linear.fit_logistic(data, linear.LogisticParams(tol=1e-10))
    binomial = linear.fit_binomial(data, tol=1e-10)
    assert np.allclose(logistic.coefficients, binomial.coefficients, atol=1e-4)
    assert np.isclose(logistic.intercept, binomial.intercept, atol=1e-4)
    table = linear.coefficient_table(logistic, LOGISTIC_FEATURES, data.sparkSession)
    assert table.count() == 7
    assert binomial.summary.deviance > 0


def test_logistic_grid_equals_spark_cross_validation(data):
    folded = prepare.with_fold(data, "key", 2).persist()
    grid = {"regParam": [0.0, 0.1], "maxIter": [2, 50], "elasticNetParam": [0.0, 1.0]}
    estimator = linear.LogisticParams().estimator()
    ours = tune.logistic_cross_validate(folded, estimator, 2, grid).orderBy("point").collect()
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder.addGrid(estimator.getParam(name), values)
    evaluator = BinaryClassificationEvaluator(labelCol="binaryLabel", numBins=0)
    model = tune.cross_validate(estimator, builder.build(), evaluator, folded, 2, "fold")
    by_point = {
        (r["reg_param"], r["max_iter"], r["elastic_net"]): r["metric"] for r in ours
    }
    assert len(by_point) == 8
    for point, metric in zip(model.getEstimatorParamMaps(), model.avgMetrics):
        values = {p.name: v for p, v in point.items()}
        key = (values["regParam"], values["maxIter"], values["elasticNetParam"])
        assert np.isclose(by_point[key], metric, atol=1e-9), key
    assert len(tune.logistic_points()) == 27


def test_job_options_are_checked_first():
    jobs.ElmJobParams(fracTest=0.5)
    for bad in (0.7, 0.05, 1.0):
        with pytest.raises(ValueError, match="fracTest"):
            jobs.ElmJobParams(fracTest=bad)
    with pytest.raises(ValueError, match="hiddenNodes"):
        jobs.ElmJobParams(hiddenNodes=5)
    with pytest.raises(ValueError, match="custard"):
        jobs.ElmJobParams(activationFunc="custard")
    with pytest.raises(ValueError, match="fracTest"):
        jobs.LogisticJobParams(fracTest=0.7)


def _values(report):
    return {(r["stage"], r["metric"], r["note"]): r["value"] for r in report.collect()}


@pytest.mark.parametrize("key", [None, "key"])
def test_network_job(spark, signal, key):
    params = jobs.ElmJobParams(key=key, hiddenNodes=40)
    result = jobs.run_elm(spark, signal, params)
    values = _values(result.report)
    samples = values["data", "samples", None]
    assert samples == prepare.labelled(signal).count()
    assert values["train", "rows", None] + values["test", "rows", None] == samples
    assert values["test", "auroc", None] > 0.9
    assert result.grid.count() == 8
    best = result.grid.where("rank = 1").first()
    assert result.best.getHiddenNodes() == best["hidden_nodes"]
    assert values["tune", "best misclassification", None] == best["error"]


def test_network_job_on_files(spark, recording):
    result = jobs.run_elm(spark, str(recording), jobs.ElmJobParams(hiddenNodes=10, tune=False))
    assert _values(result.report)["data", "samples", None] == 87
    with pytest.raises(ValueError, match="bla"):
        jobs.run_elm(spark, str(recording), jobs.ElmJobParams(features=("bla",)))


def test_logistic_jobs(spark, signal):
    grid = {"regParam": [0.0, 0.1], "maxIter": [10], "elasticNetParam": [0.0]}
    params = jobs.LogisticJobParams(key="key", grid=grid, folds=2)
    result = jobs.run_logistic(spark, signal, params)
    values = _values(result.report)
    assert values["test", "auroc", None] > 0.6
    assert len([k for k in values if k[1] == "coefficient"]) == 6
    assert result.grid.count() == 2
    pca = jobs.run_pca_logistic(
        spark, signal, jobs.LogisticJobParams(features=tuple(CHANNELS), grid=grid, folds=2)
    )
    values = _values(pca.report)
    assert len([k for k in values if k[1] == "explained variance"]) == 3
    assert pca.grid.count() == 2 and pca.best is not None


def test_exploration_job(spark, signal):
    values = _values(jobs.run_exploration(spark, signal, jobs.JobParams(key="key")).report)
    assert values["data", "all rows", None] == 2000
    for name in jobs.EXPLORE_ACTIVATIONS:
        assert values[name, "train accuracy", None] > 0.7
        assert values[name, "test accuracy", None] > 0.7
    assert 0 < values["binomial", "train error", None] < 1


def test_jobs_prune_columns(spark, signal):
    path = to_parquet(signal, scratch_path(spark, "signal"))
    frame = jobs._training_frame(spark, spark.read.parquet(path), jobs.ElmJobParams(), False)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert sorted(read[len("struct<"):-1].split(",")) == sorted(
        [f"{c}:double" for c in CHEST] + ["activityLabel:double"]
    )
    assert "GreaterThan(activityLabel,0.0)" in plan
    assert "Exchange" not in plan
    assert set(GLM_FEATURES) <= set(CHANNELS)




def _with_null(spark, column):
    rows = [(i / 400, float(i % 2), float(i % 3 > 0)) for i in range(400)]
    odd = [None if c == column else 0.5 for c in ("score", "binaryLabel", "prediction")]
    schema = "score double, binaryLabel double, prediction double"
    return spark.createDataFrame([*rows, tuple(odd)], schema).repartition(5)


@pytest.mark.parametrize("column", ["score", "binaryLabel", "prediction"])
def test_metrics_fail_on_a_null(spark, column):
    df = _with_null(spark, column)
    works = {
        "score": [
            lambda: evaluate.area_under(df, "score"),
            lambda: evaluate.area_under(df, "score", metric="areaUnderPR"),
            lambda: evaluate.threshold_sweep(df, "score", "binaryLabel").collect(),
        ],
        "prediction": [
            lambda: evaluate.error_metrics(df).collect(),
            lambda: evaluate.error_breakdown(df).collect(),
            lambda: evaluate.confusion_counts(df).collect(),
        ],
    }
    works["binaryLabel"] = works["score"] + works["prediction"]
    for work in works[column]:
        with pytest.raises(Exception, match="null"):
            work()


def test_area_takes_one_range_exchange(spark):
    """Scores that are nearly all distinct, and some of very many rows, over several tasks."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(30_000, numPartitions=6).select(
        F.when(F.col("id") % 4 == 0, F.lit(0.25)).otherwise(F.col("id") * 7919 % 30_011 / 30_011.0).alias("score"),
        (F.xxhash64("id") % 3 > 0).cast("double").alias("binaryLabel"),
    )
    exact = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="binaryLabel", numBins=0
    ).evaluate(df)
    assert np.isclose(evaluate.area_under(df, "score"), exact, atol=1e-12)
    zeros = spark.createDataFrame([(0.0, 1.0), (-0.0, 0.0)], "score double, binaryLabel double")
    assert evaluate.area_under(zeros, "score") == 0.5


def test_online_rows_are_many_files_a_batch(spark, signal):
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    known = set(root.glob("*"))
    report = jobs.run_online_exploration(spark, signal, sizes=(10,)).collect()
    labelled = signal.where(f"{LABEL} > 0").count()
    assert [r["value"] for r in report if r["metric"] == "rows"] == [labelled] * 3
    for folder in set(root.glob("stream-*")) - known:
        held = [spark.read.parquet(str(f)).count() for f in folder.glob("*.parquet")]
        assert len(held) >= 3 * spark.sparkContext.defaultParallelism
        assert max(held) <= 2 * labelled / len(held)
    states = [len(list(f.glob("run=*/batch=*"))) for f in set(root.glob("online-state-*")) - known]
    assert states and min(states) >= 2


def test_components_of_the_job_are_fitted_once_a_part(spark, signal, monkeypatch):
    fits, fit = [], PCA._fit
    monkeypatch.setattr(PCA, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    grid = {"regParam": [0.0], "maxIter": [50], "elasticNetParam": [0.0]}
    params = jobs.LogisticJobParams(features=tuple(CHANNELS), key="key", grid=grid, folds=2)
    found = jobs.run_pca_logistic(spark, signal, params)
    # the training part's, which the tuned model shares, and those of two folds
    assert len(fits) == 3
    values = _values(found.report)
    rows = prepare.with_binary_label(prepare.labelled(signal))
    _, held = prepare.hash_split(rows, "key", params.fracTest, jobs.SPLIT_SEED)
    for stage, model in (("test", found.model), ("tuned", found.best)):
        scored = model.transform(held)
        assert values[stage, "rows", None] == scored.count()
        assert values[stage, "auroc", None] == pytest.approx(evaluate.area_under(scored), abs=1e-9)


def test_wide_rows_of_the_job_are_not_kept_in_memory(spark, signal, monkeypatch):
    """Batches of 23 channels outgrow an executor while they are kept; they lie in files, assembled once."""
    held, kept = [], jobs.kept

    def noted(df, *args):
        held.append(df.columns)
        return kept(df, *args)

    monkeypatch.setattr(jobs, "kept", noted)
    root = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    known = set(root.glob("channels-*"))
    params = jobs.LogisticJobParams(features=tuple(CHANNELS), key="key", tune=False)
    values = _values(jobs.run_pca_logistic(spark, signal, params).report)
    assert held and not any("channels" in columns for columns in held)
    (folder,) = set(root.glob("channels-*")) - known
    stored = spark.read.parquet(str(folder))
    assert sorted(stored.columns) == ["binaryLabel", "channels", "key"]
    assert stored.count() == values["data", "samples", None] == signal.where(f"{LABEL} > 0").count()


def test_exploration_trains_all_widths_in_one_stream_of_each_input(spark, signal, monkeypatch):
    starts, start = [], OnlineElm.start
    monkeypatch.setattr(OnlineElm, "start", lambda self, *args, **kw: starts.append(self) or start(self, *args, **kw))
    report = jobs.run_online_exploration(spark, signal, sizes=(10, 16, 12)).collect()
    assert len(starts) == 3
    values = {(r["stage"], r["metric"], r["note"]): r["value"] for r in report}
    assert len(values) == len(report) == 27
    rows = prepare.with_binary_label(prepare.labelled(signal)).select(
        "binaryLabel", F.array(*CHANNELS[:3]).alias("features")
    )
    for nodes in (10, 16, 12):
        alone = ElmClassifier(hiddenNodes=nodes, activationFunc="sigmoid", decisionThreshold=0.5).fit(rows)
        error = evaluate.error_metrics(alone.transform(rows)).first()["misclassification"]
        assert values["online channels", "train error", f"{nodes} nodes"] == pytest.approx(error, abs=1e-9)


def test_errors_of_several_predictions_from_one_scan(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 1.0), (1.0, 0.0, 0.0)], "binaryLabel double, a double, b double")
    found = evaluate.error_metrics_of(df, ["a", "b"]).collect()
    assert [(r["prediction"], r["total"], r["rows"]) for r in found] == [("a", 1.0, 3), ("b", 2.0, 3)]
    for p, row in zip("ab", found):
        assert row["misclassification"] == evaluate.error_metrics(df, p).first()["misclassification"]
    with pytest.raises(Exception, match="no rows to evaluate"):
        evaluate.error_metrics_of(df.limit(0), ["a"]).collect()
    with pytest.raises(Exception, match="null prediction"):
        evaluate.error_metrics_of(df.withColumn("a", F.lit(None).cast("double")), ["a", "b"]).collect()
