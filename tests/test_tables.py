import collections

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sensorlab.functions.labels import above, binary_label
from sensorlab.operators import aggregates, features, prepare
from sensorlab.operators.transformers import ThresholdBinarizer
from sensorlab.schema import CHEST, LABEL


def test_binary_label_rule(spark):
    codes = [0.5, 1.0, 2.0, 3.0, 3.5, 4.0, 12.0]
    df = spark.createDataFrame([(c,) for c in codes], "activityLabel double")
    got = [r[0] for r in df.select(binary_label()).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0]
    assert df.select(binary_label(dtype="int").alias("y")).schema["y"].dataType.typeName() == "integer"


def test_binary_counts_add_up(signal):
    rows = prepare.with_binary_label(prepare.labelled(signal))
    counts = {r["binaryLabel"]: r["count"] for r in aggregates.count_by(rows, "binaryLabel").collect()}
    assert sum(counts.values()) == rows.count()
    totals = aggregates.range_label_totals(signal, [(1, 3), (4, 12)]).first()
    assert (totals["1_3"], totals["4_12"]) == (counts[0.0], counts[1.0])
    assert prepare.unlabelled(signal).count() + rows.count() == signal.count()


def test_threshold_binarizer(spark):
    df = spark.createDataFrame([(0,), (3,), (4,)], "activityLabel int")
    stage = ThresholdBinarizer()
    out = stage.transform(df)
    assert [r["binaryLabel"] for r in out.collect()] == [0.0, 0.0, 1.0]
    assert out.schema["binaryLabel"].metadata["ml_attr"]["type"] == "binary"
    with pytest.raises(ValueError, match="already"):
        stage.transform(out)
    with pytest.raises(ValueError, match="numeric"):
        stage.transform(df.select(F.col(LABEL).cast("string").alias(LABEL)))
    assert stage.copy().setThreshold(1.0).getThreshold() == 1.0


def test_unique_ids(signal):
    rows = prepare.with_unique_id(signal)
    assert rows.select("uniqueID").distinct().count() == signal.count()


def test_minmax_and_symmetric(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(11)], "x double, same double")
    got = prepare.minmax(df, "x", "n").orderBy("x").collect()
    assert got[0]["n"] == 0.0 and got[10]["n"] == 1.0 and got[5]["n"] == 0.5
    assert prepare.minmax(df, "same", "n").first()["n"] is None
    both = prepare.scale_symmetric(df, ["x"]).agg(F.min("x"), F.max("x")).first()
    assert tuple(both) == (-1.0, 1.0)
    plan = prepare.minmax(df, "x", "n")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_hash_split_ignores_partitioning(signal):
    train, test = prepare.hash_split(signal, "key", 0.3)
    _, again = prepare.hash_split(signal.repartition(7), "key", 0.3)
    keys = {r["key"] for r in test.select("key").collect()}
    assert keys == {r["key"] for r in again.select("key").collect()}
    assert train.count() + len(keys) == signal.count()
    assert abs(len(keys) - 0.3 * signal.count()) < 20


def test_large_and_negative_keys_hash_in_range(spark):
    df = spark.createDataFrame([(2**62,), (-5,), (2**31 - 1,), (-(2**63),)], "key long")
    values = [r[0] for r in df.select(prepare.unit_hash(F.col("key"))).collect()]
    assert all(0 <= v < 2**32 for v in values)
    wide = spark.range(10**6).select((F.col("id") * 10**10).alias("key"))
    _, test = prepare.hash_split(wide, "key", 0.25)
    assert abs(test.count() / 10**6 - 0.25) < 0.01


def test_folds_are_even_within_a_part(signal):
    _, test = prepare.hash_split(signal, "key", 0.5)
    counts = [r["count"] for r in prepare.with_fold(test, "key", 4).groupBy("fold").count().collect()]
    assert len(counts) == 4 and min(counts) > 0.75 * max(counts)


def test_random_split_is_a_partition(signal):
    train, test = prepare.random_split(signal, 0.6)
    assert train.count() + test.count() == signal.count()
    assert train.select("key").intersect(test.select("key")).count() == 0


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.5, 0.999, 1.0])
def test_exact_split_size(signal, fraction):
    chosen, rest = prepare.exact_split(signal, "key", fraction)
    assert chosen.count() == int(fraction * 2000)
    assert rest.count() == 2000 - int(fraction * 2000)
    assert chosen.select("key").intersect(rest.select("key")).count() == 0


def test_exact_split_breaks_ties_by_key(spark):
    keys = list(range(50)) + [k + 2**62 for k in range(50)]  # pairs of equal hash
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    assert df.select(prepare.unit_hash(F.col("key"))).distinct().count() == 50
    for wanted in (36, 37):
        chosen, rest = prepare.exact_split(df, "key", wanted / 100)
        assert (chosen.count(), rest.count()) == (wanted, 100 - wanted)


def test_exact_split_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1,)] * 10, "key long")
    with pytest.raises(ValueError, match="unique"):
        prepare.exact_split(df, "key", 0.5)


def test_union_keeps_duplicates(spark):
    df = spark.range(3)
    assert prepare.union_all([df, df, df]).count() == 9
    with pytest.raises(ValueError):
        prepare.union_all([])


def test_word_count_matches_plain_count(spark):
    texts = ["This is the first line", "a  b ", "   ", "", "the the", "tail   "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    expected = collections.Counter()
    for t in texts:
        words = t.split(" ")
        while len(words) > 1 and words[-1] == "":
            words.pop()
        if t and not t.strip(" "):
            words = []
        expected.update(words)
    got = {r["word"]: r["count"] for r in aggregates.word_count(df).collect()}
    assert got == dict(expected)


def test_reconcile_total(signal):
    rows = aggregates.reconcile(signal, LABEL).collect()
    total = [r["count"] for r in rows if r["is_total"]]
    assert total == [sum(r["count"] for r in rows if not r["is_total"])] == [2000]


def test_class_count(spark):
    ok = spark.createDataFrame([(0.0,), (2.0,)], "binaryLabel double")
    assert aggregates.class_count(ok).first()[0] == 3
    with pytest.raises(PySparkException):
        aggregates.class_count(spark.createDataFrame([(0.5,)], "binaryLabel double")).collect()


def test_features(signal):
    rows = features.assemble(signal, CHEST)
    assert features.feature_count(rows).first()[0] == 3
    sliced = features.slice_by_name(rows, ["acc_Chest_Z"]).select("acc_Chest_Z", "sliced").first()
    assert sliced["sliced"].toArray().tolist() == [sliced["acc_Chest_Z"]]
    assert features.slice_by_index(rows, [0, 1]).first()["sliced"].size == 2
    with pytest.raises(ValueError):
        features.assemble(signal, ["bla"])


def test_ragged_vectors_are_found(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "features array<double>")
    with pytest.raises(PySparkException):
        features.feature_count(df).collect()


def test_covariance_and_components(signal):
    x = np.array(signal.select(*CHEST).collect())
    cells = features.covariance(features.assemble(signal, CHEST)).collect()
    got = {(r["i"], r["j"]): r["cov"] for r in cells}
    expected = np.cov(x.T)
    assert len(got) == 9
    assert all(abs(expected[i, j] - v) < 1e-10 for (i, j), v in got.items())
    model = features.fit_pca(features.assemble(signal, CHEST), 2)
    values, vectors = np.linalg.eigh(expected)
    share = (values[::-1] / values.sum())[:2]
    assert np.allclose(model.explainedVariance.toArray(), share)
    pc = model.pc.toArray()
    assert np.allclose(pc.T @ pc, np.eye(2))
    assert np.allclose(np.abs(pc), np.abs(vectors[:, ::-1][:, :2]))


def test_above(spark):
    df = spark.createDataFrame([(0.4,), (0.41,)], "p double")
    assert [r[0] for r in df.select(above("p", 0.4, "int")).collect()] == [0, 1]
