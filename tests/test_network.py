import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from sensorlab.functions.activations import ACTIVATIONS, activate, activation
from sensorlab.operators import prepare, tune
from sensorlab.operators.elm import solver
from sensorlab.operators.elm.layer import draw_layer, hidden_columns, layer_table
from sensorlab.operators.elm.model import (
    ElmClassificationModel,
    ElmClassifier,
    ElmRegressionModel,
    ElmRegressor,
    score_activations,
)
from sensorlab.operators.evaluate import MisclassificationEvaluator
from sensorlab.operators.features import cross_product
from sensorlab.operators.pinv import pseudo_inverse
from sensorlab.schema import CHEST
from sensorlab.session import scratch_path
from sensorlab.streaming.online import OnlineElm


@pytest.fixture(scope="module")
def rows(signal):
    df = prepare.with_binary_label(prepare.labelled(signal))
    return df.select("key", F.array(*CHEST).alias("features"), "binaryLabel").persist()


@pytest.fixture(scope="module")
def arrays(rows):
    table = rows.orderBy("key").collect()
    return np.array([r["features"] for r in table]), np.array([r["binaryLabel"] for r in table])


@pytest.mark.parametrize("name", ACTIVATIONS)
def test_activation_columns_equal_arrays(spark, name):
    z = [-30.0, -1.5, -0.0, 0.0, 0.3, 2.0, 30.0]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    got = [r[0] for r in df.select(activation(name, F.col("z"))).collect()]
    assert np.allclose(got, activate(name, np.array(z)), rtol=1e-12, atol=1e-15)


def test_unknown_activation():
    with pytest.raises(ValueError, match="custard"):
        draw_layer(10, 3, "custard")


@pytest.mark.parametrize("init", ["uniform", "normal", "arithmetic"])
def test_wide_layers_contain_narrow_ones(init):
    wide, narrow = draw_layer(50, 3, init=init), draw_layer(20, 3, init=init)
    first = wide.first(20)
    assert np.array_equal(first.weights, narrow.weights)
    assert np.array_equal(first.bias, narrow.bias)
    if init != "normal":
        assert 0 <= wide.weights.min() and wide.weights.max() < 1
    if init != "arithmetic":
        other = draw_layer(50, 3, init=init, seed=1)
        assert not np.array_equal(other.weights, wide.weights)


def test_layer_table_and_columns(spark, rows, arrays):
    layer = draw_layer(10, 3, "sin")
    assert layer_table(spark, layer).count() == 10
    x = [F.col("features")[i] for i in range(3)]
    h = rows.orderBy("key").select(*hidden_columns(x, layer)).collect()
    assert np.allclose(np.array(h), layer.outputs(arrays[0]), atol=1e-13)
    with pytest.raises(ValueError):
        hidden_columns(x[:2], layer)


@pytest.mark.parametrize("name, nodes", [("tanh", 10), ("sin", 40), ("sigmoid", 25), ("radbas", 30)])
def test_fit_equals_dense_pseudo_inverse(rows, arrays, name, nodes):
    x, y = arrays
    model = ElmClassifier(activationFunc=name, hiddenNodes=nodes).fit(rows)
    h = model.layer.outputs(x)
    direct = h @ (np.linalg.pinv(h, rcond=solver.RCOND) @ y)
    got = [r["t"] for r in rows.orderBy("key").select(model.score(rows).alias("t")).collect()]
    assert np.allclose(got, direct, atol=1e-6)


def test_fit_does_not_depend_on_partitioning(rows):
    fits = [
        ElmClassifier(hiddenNodes=10).fit(rows.repartition(n)).beta for n in (1, 3, 13)
    ] + [ElmClassifier(hiddenNodes=10, fitPartitions=5).fit(rows).beta]
    for beta in fits[1:]:
        assert np.allclose(beta, fits[0], rtol=1e-6)


def test_second_reduction_level(rows, monkeypatch):
    once = ElmClassifier(hiddenNodes=10).fit(rows).beta
    monkeypatch.setattr(solver, "DRIVER_BYTES", 2000)
    twice = ElmClassifier(hiddenNodes=10).fit(rows.repartition(9)).beta
    assert np.allclose(once, twice, rtol=1e-6)


def test_folded_factor_keeps_the_gram_matrix():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(5000, 7))
    factor = None
    for block in np.array_split(a, 9):
        factor = solver.fold(factor, block)
    assert factor.shape == (7, 7)
    assert np.allclose(factor.T @ factor, a.T @ a)
    tiny = solver.fold(None, a[:3])
    assert np.allclose(tiny.T @ tiny, a[:3].T @ a[:3])


def _blocks(kind, width=12, rows=40_000):
    rng = np.random.default_rng(11)
    a = rng.normal(size=(rows, width))
    if kind == "decaying":
        a *= 10.0 ** -np.arange(width)
    elif kind == "deficient":
        a[:, 5] = a[:, 4] - a[:, 3]
        a[:, 7] = 0.0
    elif kind == "late":
        # a column that is constant at first, then far away
        a[: rows // 2, 2] = 1.0
        a[rows // 2 :, 2] *= 1e6
    elif kind == "sorted":
        a = a[np.lexsort((a[:, 1].round(1), a[:, 0].round(1)))]
        a = np.tanh(a @ rng.random((width, width)))
    elif kind == "zero":
        a[:] = 0.0
    return a


@pytest.mark.parametrize("kind", ["plain", "decaying", "deficient", "late", "sorted", "zero"])
def test_row_factor_is_as_good_as_qr(kind):
    a = _blocks(kind)
    sums = solver.RowFactor()
    for block in np.array_split(a, 41):
        sums.add(block)
    got = np.linalg.svd(sums.settle(), compute_uv=False)
    expected = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(got, expected, rtol=1e-9, atol=1e-12 * expected[0] + 1e-300)
    assert sums.rows == len(a)
    if kind != "zero":
        y = a @ np.ones(12)
        design = solver.RowFactor()
        for block in np.array_split(np.column_stack([a, y]), 41):
            design.add(block)
        assert np.allclose(a @ solver.solve(design.settle()), y, atol=1e-6 * np.abs(y).max())


def test_rank_deficient_fit_has_minimum_norm(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 1))
    a = np.hstack([x, 2 * x, rng.normal(size=(300, 1))])
    y = a @ [1.0, 0.0, 3.0] + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame(
        [(r.tolist(), float(v)) for r, v in zip(a, y)], "features array<double>, y double"
    )
    factor = solver.gather(solver.design_rows(df, lambda b: [b], "features", "y"), 4)[0]
    assert np.allclose(solver.solve(factor), np.linalg.pinv(a, rcond=1e-11) @ y)
    assert np.allclose(solver.solve(factor, 1), np.linalg.lstsq(a[:, :1], y, rcond=None)[0])


def test_gram_rows(rows, arrays):
    x, y = arrays
    layer = draw_layer(4, 3)
    h = layer.outputs(x)
    columns = hidden_columns([F.col("features")[i] for i in range(3)], layer)
    got = {(r["i"], r["j"]): r["value"] for r in solver.gram(rows, columns, F.col("binaryLabel")).collect()}
    g = h.T @ h
    for (i, j), value in got.items():
        assert np.isclose(value, g[i, j] if j >= 0 else h[:, i] @ y)
    assert len(got) == 4 * 5 // 2 + 4


def test_layer_moments(rows, arrays):
    x, y = arrays
    layer = draw_layer(30, 3)
    got = solver.layer_moments(rows, layer, [F.col("binaryLabel"), F.lit(1.0)]).collect()
    expected = layer.outputs(x).T @ np.column_stack([y, np.ones(len(y))])
    assert len(got) == 60
    assert all(np.isclose(r["value"], expected[r["node"], r["target"]]) for r in got)


def test_bad_training_rows(spark, rows):
    elm = ElmClassifier(hiddenNodes=10)
    with pytest.raises(ValueError, match="empty"):
        elm.fit(rows.limit(0))
    with pytest.raises(PySparkException, match="0 or 1"):
        elm.fit(rows.withColumn("binaryLabel", F.lit(2.0)))
    null = rows.withColumn("features", F.array(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)))
    with pytest.raises(PySparkException, match="null inside"):
        elm.fit(null)
    with pytest.raises(PySparkException, match="not finite"):
        elm.fit(rows.withColumn("features", F.array(*[F.lit(float("nan"))] * 3)))
    ragged = rows.withColumn(
        "features", F.when(F.col("key") > 5, F.col("features")).otherwise(F.array(F.lit(1.0)))
    )
    with pytest.raises(PySparkException):
        elm.fit(ragged)


def test_parameters():
    elm = ElmClassifier()
    assert (elm.getActivationFunc(), elm.getHiddenNodes(), elm.getFracTest()) == ("tanh", 100, 0.6)
    assert elm.setActivationFunc("sin").setHiddenNodes(40).setFracTest(0.3).getFracTest() == 0.3
    for setter, bad in (
        (elm.setActivationFunc, "custard"),
        (elm.setHiddenNodes, 9),
        (elm.setHiddenNodes, 1001),
        (elm.setFracTest, 0.05),
        (elm.setFracTest, 0.71),
        (elm.setInit, "zeros"),
    ):
        with pytest.raises(ValueError):
            setter(bad)
    copied = elm.copy({elm.hiddenNodes: 55})
    assert (copied.getHiddenNodes(), elm.getHiddenNodes()) == (55, 40)
    assert copied.uid == elm.uid and elm.uid.startswith("ElmClassifier")
    assert "hiddenNodes" in elm.explainParams()


def test_model_columns_and_prediction(rows):
    model = ElmClassifier(hiddenNodes=20, featuresCol="features", rawPredictionCol="raw").fit(rows)
    assert (model.numFeatures, model.numClasses, model.getHiddenNodes()) == (3, 2, 20)
    out = model.transform(rows)
    assert out.columns == [*rows.columns, "raw", "prediction"]
    assert out.count() == rows.count()
    for r in out.limit(50).collect():
        assert r["raw"][0] == -r["raw"][1]
        assert r["prediction"] == float(r["raw"][1] > 0)
        vector = Vectors.dense(r["features"])
        assert np.allclose(model.predictRaw(vector).toArray(), r["raw"].toArray())
        assert model.predict(vector) == r["prediction"]
    middle = model.copy().setDecisionThreshold(0.5).transform(rows)
    error = MisclassificationEvaluator().evaluate(middle)
    assert error < 0.25 < MisclassificationEvaluator().evaluate(out)


def test_vector_features_in_a_pipeline(signal, rows):
    data = prepare.with_binary_label(prepare.labelled(signal))
    assembler = VectorAssembler(inputCols=CHEST, outputCol="features")
    elm = ElmClassifier(hiddenNodes=15)
    model = Pipeline(stages=[assembler, elm]).fit(data)
    assert np.allclose(model.stages[-1].beta, elm.fit(rows).beta, rtol=1e-6)


def test_all_activations_at_once(rows, arrays):
    layer = draw_layer(12, 3)
    betas = {n: np.linspace(-1, 1, 12) for n in ("sigmoid", "tanh", "sin")}
    t = rows.orderBy("key").select(score_activations(F.col("features"), layer, betas).alias("t"))
    got = t.select("t.*").collect()
    z = arrays[0] @ layer.weights.T + layer.bias
    for n, beta in betas.items():
        assert np.allclose([r[n] for r in got], activate(n, z.copy()) @ beta)


def test_save_and_load(spark, rows):
    elm = ElmClassifier(hiddenNodes=12, activationFunc="sin", decisionThreshold=0.5, seed=4)
    path = scratch_path(spark, "estimator")
    elm.save(path)
    again = ElmClassifier.load(path)
    assert [again.getOrDefault(p.name) for p in elm.params] == [elm.getOrDefault(p) for p in elm.params]
    model = elm.fit(rows)
    model_path = scratch_path(spark, "model")
    model.save(model_path)
    loaded = ElmClassificationModel.load(model_path)
    assert loaded.uid == model.uid and loaded.getActivationFunc() == "sin"
    assert np.array_equal(loaded.beta, model.beta)
    differing = model.transform(rows).select("key", "prediction").exceptAll(
        loaded.transform(rows).select("key", "prediction")
    )
    assert differing.count() == 0
    pipeline_path = scratch_path(spark, "pipeline")
    Pipeline(stages=[elm]).fit(rows).save(pipeline_path)
    stage = PipelineModel.load(pipeline_path).stages[0]
    assert np.array_equal(stage.beta, model.beta)


def test_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 50, 100)
    df = spark.createDataFrame([(float(v), float(np.sqrt(v))) for v in x], "x double, y double")
    scaled = prepare.scale_symmetric(df, ["x", "y"]).select(F.array("x").alias("features"), "y")
    for name, limit in (("tanh", 1e-3), ("hardlim", 1.0)):
        model = ElmRegressor(labelCol="y", hiddenNodes=40, activationFunc=name).fit(scaled)
        out = model.transform(scaled)
        error = out.agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
        assert error <= limit * scaled.agg(F.var_pop("y")).first()[0] + 1e-12
    path = scratch_path(spark, "regressor")
    model.save(path)
    assert np.array_equal(ElmRegressionModel.load(path).beta, model.beta)


def test_stream_equals_batch_and_repeats_are_harmless(spark, rows):
    layer = draw_layer(10, 3)
    batch = ElmClassifier(hiddenNodes=10).fit(rows).beta
    folder = scratch_path(spark, "stream")
    rows.repartition(5).write.parquet(folder)
    online = OnlineElm(spark, layer, scratch_path(spark, "state"))
    with pytest.raises(ValueError):
        online.model()
    stream = (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    )
    online.start(stream, scratch_path(spark, "checkpoint")).awaitTermination()
    assert np.allclose(online.model().beta, batch, rtol=1e-6)
    states = spark.read.parquet(online.state_path).select("batch").distinct().count()
    assert states == 2

    manual = OnlineElm(spark, layer, scratch_path(spark, "state"))
    parts = [rows.where(F.pmod("key", F.lit(3)) == i) for i in range(3)]
    manual.update(rows.limit(0), 0)
    manual.update(parts[0], 1)
    manual.update(parts[1], 2)
    manual.update(parts[1], 2)
    manual.update(rows.limit(0), 3)
    manual.update(parts[2], 4)
    manual.update(parts[2], 4)
    assert np.allclose(manual.model().beta, batch, rtol=1e-6)
    assert np.array_equal(manual.model(regression=True).beta, manual.model().beta)
    # a new process has only the written state
    restarted = OnlineElm(spark, layer, manual.state_path)
    restarted.update(parts[2], 4)
    assert np.allclose(restarted.model().beta, batch, rtol=1e-6)


def test_a_second_stream_continues_or_is_refused(spark, rows):
    layer = draw_layer(10, 3)
    folders = [scratch_path(spark, f"half{i}") for i in range(2)]
    for i, folder in enumerate(folders):
        rows.where(F.pmod("key", F.lit(2)) == i).repartition(3).write.parquet(folder)
    state = scratch_path(spark, "state")
    places = [scratch_path(spark, f"checkpoint{i}") for i in range(2)]

    def stream(i):
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folders[i])

    first = OnlineElm(spark, layer, state)
    first.start(stream(0), places[0]).awaitTermination()
    half = first.model().beta
    # the same checkpoint: nothing is new, nothing is lost
    again = OnlineElm(spark, layer, state)
    again.start(stream(0), places[0]).awaitTermination()
    assert np.allclose(again.model().beta, half)
    other = OnlineElm(spark, layer, state)
    with pytest.raises(ValueError, match="another stream"):
        other.start(stream(1), places[1])
    query = other.start(
        stream(1), places[1], after=places[0], trigger={"processingTime": "1 second"}
    )
    query.processAllAvailable()
    query.stop()
    whole = ElmClassifier(hiddenNodes=10).fit(rows).beta
    assert np.allclose(other.model().beta, whole, rtol=1e-6)


def test_models_score_streams(spark, rows):
    folder = scratch_path(spark, "live")
    rows.write.parquet(folder)
    model = ElmClassifier(hiddenNodes=10, decisionThreshold=0.5).fit(rows)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    out = scratch_path(spark, "scored")
    (
        model.transform(stream)
        .select("key", "prediction")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "scored-checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    batch = model.transform(rows).select("key", "prediction")
    live = spark.read.parquet(out)
    assert live.count() == rows.count() and live.exceptAll(batch).count() == 0


def test_grid_equals_spark_cross_validation(rows):
    folded = prepare.with_fold(rows, "key", 3).persist()
    points = tune.elm_grid_points("tanh", 15)
    assert points == [(a, n) for a in ("tanh", "sin") for n in (10, 15, 100, 150)]
    points = [("tanh", 10), ("tanh", 15), ("sin", 10), ("sin", 15)]
    ours = tune.elm_cross_validate(folded, points, threshold=0.5).orderBy("point").collect()
    elm = ElmClassifier(decisionThreshold=0.5)
    grid = (
        ParamGridBuilder()
        .addGrid(elm.activationFunc, ["tanh", "sin"])
        .addGrid(elm.hiddenNodes, [10, 15])
        .build()
    )
    model = tune.cross_validate(elm, grid, MisclassificationEvaluator(), folded, 3, "fold")
    assert np.allclose([r["error"] for r in ours], model.avgMetrics)
    assert {r["rows"] for r in ours} == {rows.count()}
    report = tune.grid_report(model, rows.sparkSession).where("rank = 1").first()
    best = min(ours, key=lambda r: r["rank"])
    assert report["params"]["hiddenNodes"] == str(best["hidden_nodes"])
    with pytest.raises(ValueError, match="folds"):
        tune.elm_cross_validate(folded.where("fold < 2"), points)


def test_pseudo_inverse(spark, rows, arrays):
    x = arrays[0]
    out = pseudo_inverse(rows, 3)
    got = np.array([r["pinv"] for r in out.orderBy("key").collect()])
    assert np.allclose(got.T, np.linalg.pinv(x))
    cells = cross_product(out, "pinv", "features").collect()
    assert np.allclose([c["value"] for c in cells], [float(c["i"] == c["j"]) for c in cells])
    flat = rows.withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))
    with pytest.raises(ValueError, match="singular"):
        pseudo_inverse(flat, 2)


def test_gather_is_a_tree_of_fixed_fan_in(spark, monkeypatch):
    assert solver.bucket_levels(51, 1) == [1024]
    assert solver.bucket_levels(1001, 9) == [1024, 32, 1]
    rng = np.random.default_rng(0)
    parts = 3
    blocks = [(b, p, rng.normal(size=4).tolist()) for b in range(200) for p in range(parts)]
    factors = spark.createDataFrame(blocks, solver.FACTOR).repartition(7)
    monkeypatch.setattr(solver, "DRIVER_BYTES", 1)
    found = solver.gather(factors, 4, parts)
    for part in range(parts):
        rows_ = np.array([r for _, p, r in blocks if p == part])
        assert np.allclose(found[part].T @ found[part], rows_.T @ rows_)
