"""What must hold whatever the size of the tables: plans, skew, what is collected."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlab.operators import aggregates, prepare
from sensorlab.operators.elm import solver
from sensorlab.operators.elm.layer import draw_layer
from sensorlab.operators.elm.model import ElmClassifier
from sensorlab.plans import all_queries
from sensorlab.schema import CHEST

QUERIES, _ = all_queries()
ROW_LEVEL = [
    name
    for name, query in QUERIES.items()
    if query.__module__.endswith(("table_queries", "source_queries"))
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_no_pairwise_joins_and_no_windows_over_rows(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert not re.search(r"\bWindow\b", plan)


@pytest.mark.parametrize(
    "name, columns",
    [
        ("labelled_rows", {"l_suppkey", "l_linenumber"}),
        ("count_by_activity", {"l_linenumber"}),
        ("range_label_counts", {"l_linenumber"}),
        ("velocity_magnitude", None),
        ("word_count", {"text"}),
        ("hash_split", {"vec_id"}),
        ("elm_score", {"l_suppkey", "l_quantity", "l_discount", "l_tax", "l_linenumber"}),
    ],
)
def test_scans_read_only_what_is_used(spark, sf_dir, name, columns):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    read = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)))
    if columns is None:
        assert "l_shipdate" not in read and "l_extendedprice" not in read
    else:
        assert read == columns


def test_row_operators_do_not_shuffle(signal):
    rows = prepare.with_binary_label(prepare.labelled(signal.select("*")))
    train, test = prepare.hash_split(rows, "key", 0.3)
    folded = prepare.with_fold(train, "key", 3)
    model = ElmClassifier(hiddenNodes=10)
    features = folded.select(F.array(*CHEST).alias("features"), "binaryLabel")
    scored = model.fit(features).transform(features)
    assert "Exchange" not in plan_of(scored).split("InMemoryRelation")[0]


def test_a_hot_group_is_combined_before_the_shuffle(spark):
    hot = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 1000).alias("subject"),
        (F.col("id") % 7).cast("double").alias("activityLabel"),
    )
    counts = {r["subject"]: r["count"] for r in aggregates.count_by(hot, "subject").collect()}
    assert sum(counts.values()) == 60_000 and counts[1] > 20_000
    plan = plan_of(aggregates.count_by(hot, "subject"))
    assert "partial_count" in plan


def test_fit_with_almost_all_rows_in_one_task(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 3))
    y = (x.sum(axis=1) > 0).astype(float)
    df = spark.createDataFrame(
        [(r.tolist(), float(v)) for r, v in zip(x, y)], "features array<double>, binaryLabel double"
    )
    skewed = df.limit(5990).coalesce(1).union(df.limit(10).repartition(3))
    even = df.limit(5990).union(df.limit(10)).repartition(8)
    fits = [ElmClassifier(hiddenNodes=20).fit(d) for d in (skewed, even)]
    scores = [d.layer.outputs(x) @ d.beta for d in fits]
    assert np.allclose(scores[0], scores[1], atol=1e-5)


def test_what_the_driver_receives_is_bounded_by_the_layer(spark, monkeypatch):
    layer = draw_layer(15, 3)
    rows = spark.range(5000).select(
        F.array(F.rand(1), F.rand(2), F.rand(3)).alias("features"), F.rand(4).alias("y")
    )
    tasks = solver.design_rows(
        rows.repartition(40), lambda x: [layer.outputs(x)], "features", "y"
    )
    assert tasks.count() <= 40 * 16
    monkeypatch.setattr(solver, "DRIVER_BYTES", 0)
    received = []
    original = solver.fold
    monkeypatch.setattr(
        solver, "fold", lambda f, r: received.append(len(r)) or original(f, r)
    )
    solver.gather(tasks, 16)
    assert max(received) <= 16
