"""One solver for a whole penalty grid, and areas of many scores at once, against Spark's own."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from sensorlab.operators import evaluate, linear, penalty_grid, tune
from sensorlab.operators.features import assemble
from sensorlab.plans import all_queries

NAMES = [f"x{i}" for i in range(5)]
PENALTIES = [(0.0, 0.0), (0.01, 0.0), (0.1, 0.0), (0.01, 0.5), (0.1, 0.5), (0.01, 1.0), (0.1, 1.0)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    n = 1500
    x = rng.normal(size=(n, 5)) * [1.0, 100.0, 0.01, 3.0, 0.0] + [0.0, 5e4, 0.0, -2.0, 7.0]
    drive = 0.9 * x[:, 0] - 0.008 * (x[:, 1] - 5e4) + 30 * x[:, 2] + 0.4
    y = (rng.random(n) < 1 / (1 + np.exp(-drive))).astype(float)
    data = [(*map(float, a), float(b), int(i % 3)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in NAMES) + ", binaryLabel double, fold int")
    df = assemble(df.repartition(4), NAMES).persist()
    df.count()
    return df


def test_every_fit_equals_the_estimator(rows):
    fitted = penalty_grid.fit_penalties(
        rows, {p: [100] for p in PENALTIES}, [-1, 0, 2], fold_column="fold"
    )
    for (strength, share, fold, _), weights in fitted.items():
        train = rows if fold < 0 else rows.where(F.col("fold") != fold)
        model = LogisticRegression(
            labelCol="binaryLabel", regParam=strength, elasticNetParam=share, tol=1e-13, maxIter=1000
        ).fit(train)
        wanted = np.r_[model.intercept, model.coefficients.toArray()]
        spread = np.r_[1.0, train.select(*[F.stddev_samp(c) for c in NAMES]).first()]
        # in units of the scaled features
        assert np.allclose((weights * spread)[1:], (wanted * spread)[1:], atol=1e-6)
        assert np.isclose(weights[0], wanted[0], rtol=1e-6, atol=1e-4)
        if share == 1.0 and strength == 0.1:
            assert (weights[1:] == 0).any()


def test_limits_and_faults(rows, spark):
    fitted = penalty_grid.fit_penalties(rows, {(0.01, 0.5): [1, 2, 50, 90]}, [-1])
    found = [fitted[0.01, 0.5, -1, limit] for limit in (1, 2, 50, 90)]
    gaps = [np.abs(w[1] - found[-1][1]) for w in found]
    assert gaps[0] > gaps[1] > gaps[2] == gaps[3] == 0
    with pytest.raises(ValueError, match="no rows in folds"):
        penalty_grid.fit_penalties(rows, {(0.0, 0.0): [5]}, [7], fold_column="fold")
    with pytest.raises(ValueError, match="no rows"):
        penalty_grid.fit_penalties(rows.limit(0), {(0.0, 0.0): [5]}, [-1])
    one = rows.withColumn("binaryLabel", F.lit(1.0))
    weights = penalty_grid.fit_penalties(one, {(0.1, 0.5): [30], (0.0, 0.0): [30]}, [-1])
    assert all(np.isfinite(w).all() for w in weights.values())
    null = rows.withColumn("binaryLabel", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="null"):
        penalty_grid.fit_penalties(null, {(0.1, 0.5): [30]}, [-1])


def test_grid_equals_a_fit_per_point(rows):
    points = tune.logistic_points({"regParam": [0.0, 0.1], "maxIter": [60, 100], "elasticNetParam": [0.0, 1.0]})
    ours = penalty_grid.cross_validate_penalties(rows, points, 3).orderBy("point").collect()
    estimator = linear.LogisticParams(tol=1e-12).estimator()
    grid = {"regParam": [0.0, 0.1], "maxIter": [300], "elasticNetParam": [0.0, 1.0]}
    theirs = tune.logistic_cross_validate(rows, estimator, 3, grid).collect()
    wanted = {(r["reg_param"], r["elastic_net"]): r["metric"] for r in theirs}
    assert [r["point"] for r in ours] == list(range(8))
    for row in ours:
        assert np.isclose(row["metric"], wanted[row["reg_param"], row["elastic_net"]], atol=1e-5)
    assert sorted(r["rank"] for r in ours) == list(range(1, 9))


@pytest.mark.parametrize("partitions", [1, 5])
def test_areas_of_many_segments(spark, partitions):
    rng = np.random.default_rng(8)
    n = 4000
    segment = rng.choice([0, 1, 2, 3], n, p=[0.7, 0.2, 0.05, 0.05])
    score = np.where(segment == 1, rng.integers(0, 4, n), rng.normal(size=n).round(2))
    label = np.where(segment == 2, 1.0, np.where(segment == 3, 0.0, rng.integers(0, 2, n)))
    data = [(int(a), float(b), float(c)) for a, b, c in zip(segment, score, label)]
    df = spark.createDataFrame(data, "segment int, score double, binaryLabel double").repartition(partitions)
    found = {r["segment"]: r for r in evaluate.area_under_roc_by(df, "segment", "score").collect()}
    for s in range(4):
        own = df.where(F.col("segment") == s)
        assert np.isclose(found[s]["area"], evaluate.area_under_roc(own, "score"), atol=1e-12)
        assert found[s]["rows"] == own.count()
    assert evaluate.area_under_roc_by(df.limit(0), "segment", "score").count() == 0
    with pytest.raises(Exception, match="null segment"):
        evaluate.area_under_roc_by(df.withColumn("segment", F.lit(None)), "segment", "score").collect()


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_precision_recall_equals_spark(spark, digits):
    rng = np.random.default_rng(4)
    score = rng.normal(size=3000).round(digits) + 0.0  # one zero, as the areas have it
    label = (rng.random(3000) < 0.3 + 0.1 * score).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(score, label)], "score double, binaryLabel double")
    wanted = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="binaryLabel", metricName="areaUnderPR", numBins=0
    ).evaluate(df)
    for parts in (1, 3, 9):
        assert np.isclose(evaluate.area_under_pr(df.repartition(parts), "score"), wanted, atol=1e-12)
    ones, zeros = df.withColumn("binaryLabel", F.lit(1.0)), df.withColumn("binaryLabel", F.lit(0.0))
    assert evaluate.area_under_pr(ones, "score") == 1.0 and evaluate.area_under_pr(zeros, "score") == 0.0
    with pytest.raises(ValueError, match="no rows"):
        evaluate.area_under_pr(df.limit(0), "score")
    assert not {"aupr_check"} - set(all_queries()[0])


def test_stages_before_the_grid_are_fitted_per_fold(spark):
    """Components and a grid on them equal a fit per point and fold."""
    from pyspark.ml.feature import PCA

    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 4)) * [3, 2, 1, 0.5]
    y = (x[:, 0] + x[:, 1] + rng.normal(size=900) > 0).astype(float)
    data = [(*map(float, a), float(b), i % 2) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, binaryLabel double, fold int")
    df = assemble(df, ["a", "b", "c", "d"]).withColumnRenamed("features", "channels").repartition(3).persist()
    prefix = [PCA(k=2, inputCol="channels", outputCol="features")]
    points = tune.logistic_points({"regParam": [0.0, 0.1], "maxIter": [50], "elasticNetParam": [0.5]})
    ours = penalty_grid.cross_validate_penalties(df, points, 2, prefix=prefix).orderBy("point").collect()
    theirs = tune.logistic_cross_validate(
        df, linear.LogisticParams(tol=1e-12).estimator(), 2,
        {"regParam": [0.0, 0.1], "maxIter": [300], "elasticNetParam": [0.5]}, prefix=prefix,
    ).orderBy("point").collect()
    assert np.allclose([r["metric"] for r in ours], [r["metric"] for r in theirs], atol=1e-5)


def _counting(df, counter):
    """The same rows; the counter adds those that a task has passed on."""

    def run(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_segments_are_ranked_from_one_reading_of_the_rows(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(3_000).select(
        (F.col("id") % 3).alias("segment"), F.rand(5).alias("score"), (F.col("id") % 2).alias("binaryLabel")
    )
    found = evaluate.area_under_roc_by(_counting(rows, seen), "segment", "score").collect()
    assert [r["rows"] for r in found] == [1_000] * 3 and seen.value == 3_000


def test_grid_scores_once_and_shares_equal_problems(spark, monkeypatch):
    seen, asked = spark.sparkContext.accumulator(0), []
    counts, sums = penalty_grid.held_out_counts, penalty_grid._newton_sums
    monkeypatch.setattr(penalty_grid, "held_out_counts", lambda *a: _counting(counts(*a), seen))

    def watched(centre, deviation, problems):
        asked.append(len(problems))
        return sums(centre, deviation, problems)

    monkeypatch.setattr(penalty_grid, "_newton_sums", watched)
    rows = spark.range(2_000).select(
        F.array(F.rand(1), F.rand(2)).alias("features"),
        (F.rand(3) > 0.4).cast("double").alias("binaryLabel"),
        (F.col("id") % 2).cast("int").alias("fold"),
    ).localCheckpoint()
    points = [{"regParam": r, "elasticNetParam": 0.0, "maxIter": 50} for r in (0.0, 0.01, 0.1)]
    assert penalty_grid.cross_validate_penalties(rows, points, 2).count() == 3
    # every row is held out once for each point, and at weights of zero the points of a fold are one
    assert seen.value == 3 * 2_000
    assert asked[0] == 2 and max(asked) == 6


def test_grid_query_takes_few_jobs(spark, sf_dir):
    context = spark.sparkContext
    context.setJobGroup("grid-check", "jobs of the grid query")
    try:
        assert all_queries()[0]["logistic_grid_check"](spark, sf_dir).count() == 10
        assert len(context.statusTracker().getJobIdsForGroup("grid-check")) < 60
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("block, size, sampled", [(50, 64, 8), (7, 5, 1), (1_000, 100_000, 100)])
def test_areas_from_blocks_and_ranges_of_any_size(spark, monkeypatch, block, size, sampled):
    """Ties, both zeros, infinities, NaN, a hot score and segments that lie mixed, in many ranges."""
    for name, value in (("BLOCK_SCORES", block), ("RANGE_SCORES", size), ("SAMPLED_SCORES", sampled)):
        monkeypatch.setattr(evaluate, name, value)
    rng = np.random.default_rng(3)
    n = 3000
    segment = rng.integers(0, 3, n)
    score = np.where(segment == 0, rng.normal(size=n), np.where(rng.random(n) < 0.8, 0.0, rng.normal(size=n).round(1)))
    score[:6] = [np.inf, -np.inf, -0.0, 0.0, np.nan, np.nan]
    label = rng.integers(0, 2, n)
    df = spark.createDataFrame(
        [(int(a), float(b), float(c)) for a, b, c in zip(segment, score, label)], "segment int, score double, binaryLabel double"
    ).repartition(3)
    found = {r["segment"]: r for r in evaluate.area_under_roc_by(df, "segment", "score").collect()}
    # the same steps here, where the sizes hold for the tasks, too
    columns = [pa.array(c) for c in (segment, score, label, 1 - label)]
    batch = pa.RecordBatch.from_arrays(columns, names=["segment", "score", "positives", "negatives"])
    blocks = [b for a in range(0, n, 100) for b in evaluate._blocks(iter([batch.slice(a, 100)]))]
    names = ["segment", "scores", "positives", "negatives"]
    cuts = evaluate._cuts([tuple(r[c] for c in ("segment", "size", "sample")) for b in blocks for r in b.to_pylist()])
    slices = pa.Table.from_batches(evaluate._slices(cuts)(b.select(names) for b in blocks))
    ranges = [slices.filter(pc.equal(slices["range"], r)) for r in range(pc.max(slices["range"]).as_py() + 1)]
    parts = [r for t in ranges if t.num_rows for r in evaluate._ranked_range(t).to_pylist()]
    pairs, below = [0.0] * 3, [0] * 3
    for r in parts:
        pairs[r["segment"]] += r["pairs"] + r["positives"] * below[r["segment"]]
        below[r["segment"]] += r["negatives"]
    assert len(parts) == (3 if size > n else len(parts)) and (size > n or len(parts) > 6)
    # NaN is above all numbers and equal to itself
    place = np.where(np.isnan(score), 3.0, np.where(score == np.inf, 2.0, np.where(score == -np.inf, -2.0, np.tanh(score))))
    for s in range(3):
        p, q = (place[(segment == s) & (label == y)] for y in (1, 0))
        wanted = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
        assert found[s]["rows"] == len(p) + len(q)
        assert np.isclose(found[s]["area"], wanted, atol=1e-12)
        assert np.isclose(pairs[s] / (len(p) * len(q)), wanted, atol=1e-12)
        assert np.isclose(evaluate.area_under_roc(df.where(F.col("segment") == s), "score"), wanted, atol=1e-12)


def test_scores_move_in_blocks_not_as_rows(spark, monkeypatch):
    moved = []
    monkeypatch.setattr(evaluate, "_cuts", lambda sketch, of=evaluate._cuts: moved.append(len(sketch)) or of(sketch))
    rows = spark.range(0, 20_000, 1, 4).select(F.rand(5).alias("score"), (F.col("id") % 2).alias("binaryLabel"))
    assert 0.4 < evaluate.area_under_roc(rows, "score") < 0.6
    # a block of each task
    assert moved == [4]
