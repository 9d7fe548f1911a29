"""Queries over row-level operators, counts, scalar functions and metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sensorlab.functions.activations import ACTIVATIONS, activation
from sensorlab.functions.labels import above
from sensorlab.operators import aggregates, evaluate, features, prepare
from sensorlab.operators.transformers import ThresholdBinarizer
from sensorlab.plans import oracles as o
from sensorlab.plans.jobs import VELOCITIES
from sensorlab.plans.registry import query
from sensorlab.schema import (
    CHANNELS,
    CHEST,
    LABEL,
    READING,
    all_channels,
    append_column,
    check_feature_columns,
    violation_table,
)
from sensorlab.sources.adapters import (
    labelled_readings,
    labelled_vectors,
    readings,
    table,
    vectors,
)

RANGES = [(1, 3), (4, 12)]


@query(
    "labelled_rows",
    f"WITH {o.READINGS} SELECT subject, count(*) AS count FROM readings WHERE {LABEL} > 0 "
    "GROUP BY subject",
)
def labelled_rows(spark, sf_dir):
    return aggregates.count_by(prepare.labelled(readings(spark, sf_dir)), "subject")


@query(
    "unlabelled_rows",
    f"WITH {o.READINGS} SELECT subject, count(*) AS count FROM readings WHERE {LABEL} = 0 "
    "GROUP BY subject",
)
def unlabelled_rows(spark, sf_dir):
    return aggregates.count_by(prepare.unlabelled(readings(spark, sf_dir)), "subject")


@query(
    "filter_equality",
    f"WITH {o.READINGS} SELECT subject, count(*) AS count FROM readings WHERE {LABEL} = 5 "
    "GROUP BY subject",
)
def filter_equality(spark, sf_dir):
    return aggregates.count_by(readings(spark, sf_dir).where(F.col(LABEL) == 5), "subject")


@query(
    "project_columns",
    f"WITH {o.VECTORS} SELECT vec_id, embedding[1] AS x, embedding[2] AS y, {LABEL} AS code "
    "FROM vectors",
)
def project_columns(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        "vec_id",
        F.col("embedding")[0].alias("x"),
        F.col("embedding")[1].alias("y"),
        F.col(LABEL).cast("double").alias("code"),
    )


@query(
    "row_count",
    f"WITH {o.READINGS} SELECT count(*) AS rows, {len(CHANNELS) + 3} AS columns FROM readings",
)
def row_count(spark, sf_dir):
    return aggregates.dimensions(readings(spark, sf_dir))


def _label_counts(dtype: str) -> str:
    return (
        f"WITH {o.LABELLED} SELECT {LABEL} AS code, CAST(binaryLabel AS {dtype}) AS label, "
        f"count(*) AS count FROM labelled GROUP BY ALL"
    )


@query("binary_label", _label_counts("DOUBLE"))
def binary_label(spark, sf_dir):
    rows = prepare.with_binary_label(prepare.labelled(readings(spark, sf_dir)), name="label")
    return aggregates.count_by(rows, F.col(LABEL).alias("code"), "label")


@query("indexed_label", _label_counts("INTEGER"))
def indexed_label(spark, sf_dir):
    rows = prepare.with_binary_label(
        prepare.labelled(readings(spark, sf_dir)), name="label", dtype="int"
    )
    return aggregates.count_by(rows, F.col(LABEL).alias("code"), "label")


@query(
    "threshold_binarize",
    f"WITH {o.READINGS} SELECT {LABEL} AS code, "
    f"CAST(CASE WHEN {LABEL} > 3 THEN 1 ELSE 0 END AS DOUBLE) AS label, count(*) AS count "
    "FROM readings GROUP BY ALL",
)
def threshold_binarize(spark, sf_dir):
    rows = ThresholdBinarizer(outputCol="label").transform(readings(spark, sf_dir))
    return aggregates.count_by(rows, F.col(LABEL).alias("code"), "label")


@query(
    "unique_id",
    f"WITH {o.READINGS} SELECT count(*) AS rows, count(*) AS ids FROM readings",
)
def unique_id(spark, sf_dir):
    """Ids count from the task's first id without gap: as many ids as rows."""
    rows = prepare.with_unique_id(readings(spark, sf_dir))
    task = F.shiftright("uniqueID", 33)
    tasks = rows.groupBy(task.alias("task")).agg(
        F.count("*").alias("rows"),
        (F.max("uniqueID") - F.min("uniqueID") + 1).alias("ids"),
    )
    return tasks.agg(F.sum("rows").alias("rows"), F.sum("ids").alias("ids"))


@query(
    "count_by_activity",
    f"WITH {o.READINGS} SELECT {LABEL}, count(*) AS count FROM readings GROUP BY {LABEL}",
)
def count_by_activity(spark, sf_dir):
    return aggregates.count_by(readings(spark, sf_dir), LABEL).orderBy(LABEL)


@query(
    "count_by_binary_label",
    f"WITH {o.LABELLED} SELECT binaryLabel, count(*) AS count FROM labelled GROUP BY binaryLabel",
)
def count_by_binary_label(spark, sf_dir):
    return aggregates.count_by(labelled_readings(spark, sf_dir), "binaryLabel").orderBy(
        "binaryLabel"
    )


_RANGE_SUMS = ", ".join(
    f'CAST(sum(CASE WHEN {LABEL} BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END) AS BIGINT) AS "{lo}_{hi}"'
    for lo, hi in RANGES
)


@query(
    "range_label_counts",
    f"WITH {o.READINGS} SELECT {LABEL}, {_RANGE_SUMS} FROM readings GROUP BY {LABEL}",
)
def range_label_counts(spark, sf_dir):
    return aggregates.range_label_counts(readings(spark, sf_dir), RANGES).orderBy(LABEL)


@query("range_label_totals", f"WITH {o.READINGS} SELECT {_RANGE_SUMS} FROM readings")
def range_label_totals(spark, sf_dir):
    return aggregates.range_label_totals(readings(spark, sf_dir), RANGES)


@query(
    "class_count",
    f"WITH {o.LABELLED} SELECT CAST(max(binaryLabel) + 1 AS INTEGER) AS classes FROM labelled",
)
def class_count(spark, sf_dir):
    return aggregates.class_count(labelled_readings(spark, sf_dir))


@query(
    "union_subjects",
    f"WITH {o.READINGS}, parts AS (SELECT * FROM readings WHERE {LABEL} <= 3 UNION ALL "
    f"SELECT * FROM readings WHERE {LABEL} >= 3) "
    "SELECT subject, count(*) AS count FROM parts GROUP BY subject",
)
def union_subjects(spark, sf_dir):
    """Two overlapping tables; rows in both count twice."""
    rows = readings(spark, sf_dir)
    parts = [rows.where(F.col(LABEL) <= 3), rows.where(F.col(LABEL) >= 3)]
    return aggregates.count_by(prepare.union_all(parts), "subject")


@query(
    "word_count",
    "SELECT word, count(*) AS count FROM (SELECT unnest(string_split(rtrim(text, ' '), ' ')) "
    "AS word FROM documents WHERE NOT regexp_full_match(text, ' +')) GROUP BY word",
)
def word_count(spark, sf_dir):
    return aggregates.word_count(table(spark, sf_dir, "documents"))


_VELOCITY_SQL = ", ".join(
    f"{o.rounded('sum(' + 'sqrt(' + ' + '.join(f'pow({a} * CAST(0.02 AS DOUBLE), 2)' for a in axes) + '))', 6)}"
    f" AS {name}"
    for name, axes in VELOCITIES.items()
)


@query(
    "velocity_magnitude",
    f"WITH {o.LABELLED} SELECT subject, {_VELOCITY_SQL} FROM labelled GROUP BY subject",
)
def velocity_magnitude(spark, sf_dir):
    rows = prepare.with_velocity(labelled_readings(spark, sf_dir), VELOCITIES)
    return rows.groupBy("subject").agg(*[F.round(F.sum(v), 6).alias(v) for v in VELOCITIES])


def _minmax_sql(column: str) -> str:
    return f"(({column} - min({column}) OVER ()) / (max({column}) OVER () - min({column}) OVER ()))"


@query(
    "minmax_normalize",
    f"WITH {o.LABELLED}, n AS (SELECT subject, {_minmax_sql('ecg_1')} AS s FROM labelled) "
    f"SELECT subject, {o.rounded('sum(s)', 6)} AS total, {o.rounded('max(s)', 6)} AS high "
    "FROM n GROUP BY subject",
)
def minmax_normalize(spark, sf_dir):
    rows = prepare.minmax(labelled_readings(spark, sf_dir), "ecg_1", "normal")
    return rows.groupBy("subject").agg(
        F.round(F.sum("normal"), 6).alias("total"), F.round(F.max("normal"), 6).alias("high")
    )


@query(
    "scale_symmetric",
    f"WITH {o.LABELLED}, n AS (SELECT subject, "
    + ", ".join(f"{_minmax_sql(c)} * 2 - 1 AS {c}" for c in CHEST)
    + " FROM labelled) SELECT subject, "
    + ", ".join(f"{o.rounded(f'sum({c})', 6)} AS {c}" for c in CHEST)
    + " FROM n GROUP BY subject",
)
def scale_symmetric(spark, sf_dir):
    rows = prepare.scale_symmetric(labelled_readings(spark, sf_dir), CHEST)
    return rows.groupBy("subject").agg(*[F.round(F.sum(c), 6).alias(c) for c in CHEST])


@query(
    "first_n",
    f"WITH {o.VECTORS} SELECT vec_id, {LABEL} FROM vectors ORDER BY vec_id LIMIT 12",
)
def first_n(spark, sf_dir):
    return prepare.first_n(vectors(spark, sf_dir).select("vec_id", LABEL), 12, ["vec_id"])


@query(
    "row_slice",
    f"WITH {o.VECTORS} SELECT vec_id, {LABEL} FROM vectors WHERE vec_id BETWEEN 100 AND 299",
)
def row_slice(spark, sf_dir):
    return prepare.row_slice(vectors(spark, sf_dir).select("vec_id", LABEL), 100, 299, "vec_id")


@query(
    "hash_split",
    f"WITH {o.VECTORS} SELECT vec_id, {o.knuth('vec_id', 7)} < 2576980377 AS is_test FROM vectors",
)
def hash_split(spark, sf_dir):
    train, test = prepare.hash_split(vectors(spark, sf_dir), "vec_id", 0.6, seed=7)
    return prepare.union_all(
        [
            train.select("vec_id", F.lit(False).alias("is_test")),
            test.select("vec_id", F.lit(True).alias("is_test")),
        ]
    )


@query(
    "fold_numbers",
    f"WITH {o.VECTORS} SELECT vec_id, CAST(floor({o.knuth_twice('vec_id', 5)} * 3 / 4294967296) "
    "AS INTEGER) AS fold FROM vectors",
)
def fold_numbers(spark, sf_dir):
    return prepare.with_fold(vectors(spark, sf_dir), "vec_id", 3, seed=5).select("vec_id", "fold")


@query(
    "exact_split",
    f"WITH {o.VECTORS} SELECT vec_id, row_number() OVER (ORDER BY {o.knuth('vec_id', 1234)}, "
    "vec_id) <= floor(count(*) OVER () * 0.5) AS chosen FROM vectors",
)
def exact_split(spark, sf_dir):
    chosen, rest = prepare.exact_split(vectors(spark, sf_dir), "vec_id", 0.5, seed=1234)
    return prepare.union_all(
        [
            chosen.select("vec_id", F.lit(True).alias("chosen")),
            rest.select("vec_id", F.lit(False).alias("chosen")),
        ]
    )


@query(
    "random_split",
    f"WITH {o.VECTORS} SELECT count(*) AS rows, count(*) AS in_one_part, TRUE AS near_fraction, "
    "TRUE AS same_again FROM vectors",
)
def random_split(spark, sf_dir):
    """Rows in exactly one part; the test part's size against the fraction, within five
    standard deviations; and whether the same seed gives the same parts."""
    ids = vectors(spark, sf_dir).select("vec_id")

    def parts():
        train, test = prepare.random_split(ids, 0.6)
        return prepare.union_all(
            [train.withColumn("held", F.lit(0)), test.withColumn("held", F.lit(1))]
        ).groupBy("vec_id").agg(F.count("*").alias("n"), F.sum("held").alias("held"))

    both = parts().alias("a").join(parts().alias("b"), "vec_id", "full")
    n, held = F.count("*"), F.sum("a.held")
    spread = 5 * F.sqrt(n * 0.6 * 0.4)
    return both.agg(
        n.alias("rows"),
        F.count_if((F.col("a.n") == 1) & (F.col("b.n") == 1)).alias("in_one_part"),
        (F.abs(held - n * 0.6) <= spread).alias("near_fraction"),
        F.bool_and(F.col("a.held") == F.col("b.held")).alias("same_again"),
    )


def _input_sql() -> str:
    return "(embedding[1] * 3 + embedding[2])"


def _input():
    return F.col("embedding")[0] * 3 + F.col("embedding")[1]


def _activation_query(name: str):
    @query(
        f"activation_{name}",
        f"WITH {o.VECTORS} SELECT vec_id, {o.rounded(o.activation(name, _input_sql()), 9)} AS h "
        "FROM vectors",
    )
    def run(spark, sf_dir):
        return vectors(spark, sf_dir).select(
            "vec_id", F.round(activation(name, _input()), 9).alias("h")
        )

    return run


for _name in ACTIVATIONS:
    _activation_query(_name)


@query(
    "round_label",
    f"WITH {o.VECTORS} SELECT vec_id, round(abs({_input_sql()}) * 5) AS label FROM vectors",
)
def round_label(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(F.abs(_input()) * 5).alias("label"))


def _assembled(spark, sf_dir, count=6):
    rows = vectors(spark, sf_dir)
    names = [f"x{i + 1}" for i in range(count)]
    return features.assemble(
        rows.select("vec_id", *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)]), names
    )


def _cells(array, names):
    return [array[i].alias(n) for i, n in enumerate(names)]


def _vector_cells_sql(indices) -> str:
    cells = ", ".join(f"embedding[{i}] AS v{k + 1}" for k, i in enumerate(indices))
    return f"WITH {o.VECTORS} SELECT vec_id, {cells} FROM vectors"


@query("assemble_features", _vector_cells_sql([1, 2, 3, 4, 5, 6]))
def assemble_features(spark, sf_dir):
    rows = _assembled(spark, sf_dir)
    cells = _cells(vector_to_array("features"), [f"v{i}" for i in range(1, 7)])
    return rows.select("vec_id", *cells)


@query("slice_features", _vector_cells_sql([2, 5]))
def slice_features(spark, sf_dir):
    rows = features.slice_by_name(_assembled(spark, sf_dir), ["x2", "x5"])
    return rows.select("vec_id", *_cells(vector_to_array("sliced"), ["v1", "v2"]))


@query(
    "vector_to_array",
    f"WITH {o.VECTORS} SELECT vec_id, unnest(range(64)) AS position, "
    "unnest(embedding) AS value FROM vectors",
)
def vector_to_array_(spark, sf_dir):
    rows = features.as_vector(vectors(spark, sf_dir), "embedding")
    return rows.select(
        "vec_id", F.posexplode(vector_to_array("features")).alias("position", "value")
    ).select("vec_id", F.col("position").cast("bigint").alias("position"), "value")


@query(
    "feature_count",
    f"WITH {o.VECTORS} SELECT CAST(max(len(embedding)) AS INTEGER) AS features FROM vectors",
)
def feature_count(spark, sf_dir):
    return features.feature_count(features.as_vector(vectors(spark, sf_dir), "embedding"))


# names in the schema, and three that are not
CANDIDATES = [*CHEST, "bla", "acc", "health"]


@query(
    "check_feature_columns",
    f"WITH {o.READINGS} SELECT unnest([{', '.join(repr(c) for c in CANDIDATES)}]) AS name, "
    f"unnest([TRUE, TRUE, TRUE, FALSE, FALSE, FALSE]) AS ok, "
    f"unnest([count(acc_Chest_X), count(acc_Chest_Y), count(acc_Chest_Z), 0, 0, 0]) AS filled "
    "FROM readings",
)
def check_columns(spark, sf_dir):
    """Whether each name is a feature column, and its filled cells."""
    rows = readings(spark, sf_dir)

    def known(name):
        try:
            return bool(check_feature_columns([name], READING))
        except ValueError:
            return False

    found = {c: known(c) for c in CANDIDATES}
    counts = rows.agg(*[F.count(c).alias(c) for c, ok in found.items() if ok])
    structs = [
        F.struct(
            F.lit(c).alias("name"),
            F.lit(ok).alias("ok"),
            (F.col(c) if ok else F.lit(0).cast("bigint")).alias("filled"),
        )
        for c, ok in found.items()
    ]
    return counts.select(F.inline(F.array(*structs)))


# expected kinds of some columns, the last three of which the table does not have so
EXPECTED = {
    "l_orderkey": "numeric", "l_linenumber": ["int", "bigint"], "l_quantity": "double",
    "l_returnflag": "numeric", "l_shipdate": "double", "l_nothing": "text",
}


@query(
    "check_schema",
    "SELECT unnest(['l_returnflag', 'l_shipdate', 'l_nothing']) AS name, "
    "unnest(['numeric', 'double', 'text']) AS wanted, "
    "unnest(['string', 'timestamp_ntz', 'absent']) AS found, "
    "unnest([count(l_returnflag), count(l_shipdate), 0]) AS filled FROM lineitem",
)
def check_schema(spark, sf_dir):
    """All violations at once, with the values that stand in those columns."""
    return violation_table(table(spark, sf_dir, "lineitem"), EXPECTED)


@query(
    "append_column",
    f"WITH {o.LABELLED} SELECT subject, {o.rounded('sum(ecg_1 + ecg_2)', 2)} AS total, "
    "TRUE AS refuses_taken_name FROM labelled GROUP BY subject",
)
def append_column_(spark, sf_dir):
    rows = append_column(
        labelled_readings(spark, sf_dir), "ecg_sum", F.col("ecg_1") + F.col("ecg_2")
    )
    try:
        append_column(rows, "ecg_sum", F.lit(0.0))
        refused = False
    except ValueError:
        refused = True
    return rows.groupBy("subject").agg(F.round(F.sum("ecg_sum"), 2).alias("total")).withColumn(
        "refuses_taken_name", F.lit(refused)
    )


@query(
    "all_channels",
    f"WITH {o.READINGS} SELECT unnest([{', '.join(repr(c) for c in CHANNELS)}]) AS channel, "
    f"unnest([{', '.join(o.rounded(f'avg({c})', 4) for c in CHANNELS)}]) AS mean FROM readings",
)
def all_channels_(spark, sf_dir):
    rows = readings(spark, sf_dir).drop("subject", "session_id")
    names = all_channels(rows)
    means = rows.agg(*[F.round(F.avg(c), 4).alias(c) for c in names])
    structs = [F.struct(F.lit(c).alias("channel"), F.col(c).alias("mean")) for c in names]
    return means.select(F.inline(F.array(*structs)))


# --- metrics of a score: the chest channel scaled to [0, 1] -----------------

_SCORED = (
    f"WITH {o.LABELLED}, scored AS (SELECT binaryLabel, {_minmax_sql('acc_Chest_X')} AS score "
    "FROM labelled), predicted AS (SELECT binaryLabel, "
    "CAST(CASE WHEN score > CAST(0.4 AS DOUBLE) THEN 1 ELSE 0 END AS DOUBLE) AS prediction "
    "FROM scored), gaps AS (SELECT *, (prediction - binaryLabel) * (prediction - binaryLabel) "
    "AS gap FROM predicted)"
)


def _scored(spark, sf_dir):
    return prepare.minmax(labelled_readings(spark, sf_dir), "acc_Chest_X", "score").select(
        "binaryLabel", "score"
    )


def _predicted(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("prediction", above("score", 0.4))


@query(
    "probability_threshold",
    f"{_SCORED} SELECT prediction, count(*) AS count FROM predicted GROUP BY prediction",
)
def probability_threshold(spark, sf_dir):
    return aggregates.count_by(_predicted(spark, sf_dir), "prediction")


@query(
    "squared_difference",
    f"{_SCORED} SELECT binaryLabel, CAST(sum(gap) AS DOUBLE) AS total FROM gaps "
    "GROUP BY binaryLabel",
)
def squared_difference(spark, sf_dir):
    from sensorlab.functions.labels import squared_difference as gap

    rows = _predicted(spark, sf_dir)
    return rows.groupBy("binaryLabel").agg(F.sum(gap()).alias("total"))


@query("error_total", f"{_SCORED} SELECT sum(gap) AS total, count(*) AS rows FROM gaps")
def error_total(spark, sf_dir):
    return evaluate.error_metrics(_predicted(spark, sf_dir)).select("total", "rows")


@query(
    "error_breakdown",
    f"{_SCORED} SELECT gap AS squared_diff, sum(gap) AS total, count(*) AS rows FROM gaps "
    "GROUP BY gap",
)
def error_breakdown(spark, sf_dir):
    return evaluate.error_breakdown(_predicted(spark, sf_dir))


@query("misclassification", f"{_SCORED} SELECT {o.rounded('avg(gap)', 9)} AS error FROM gaps")
def misclassification(spark, sf_dir):
    metrics = evaluate.error_metrics(_predicted(spark, sf_dir))
    return metrics.select(F.round("misclassification", 9).alias("error"))


@query(
    "confusion_counts",
    f"{_SCORED} SELECT binaryLabel, prediction, count(*) AS count FROM predicted GROUP BY ALL",
)
def confusion_counts(spark, sf_dir):
    return evaluate.confusion_counts(_predicted(spark, sf_dir))


_SWEEP = (
    f"{_SCORED}, sweep AS (SELECT step, avg(CASE WHEN (CASE WHEN score <= "
    "CAST(0.05 AS DOUBLE) * step THEN 0 ELSE 1 END) <> binaryLabel THEN 1.0 ELSE 0.0 END) "
    "AS error FROM scored, (SELECT CAST(range AS INTEGER) AS step FROM range(1, 21)) GROUP BY step)"
)


@query(
    "threshold_sweep",
    f"{_SWEEP} SELECT step, {o.rounded('CAST(0.05 AS DOUBLE) * step', 2)} AS threshold, "
    f"{o.rounded('error', 9)} AS error, {o.rounded('1 - error', 9)} AS accuracy FROM sweep",
)
def threshold_sweep(spark, sf_dir):
    sweep = evaluate.threshold_sweep(_scored(spark, sf_dir), "score", "binaryLabel")
    return sweep.select(
        "step",
        F.round("threshold", 2).alias("threshold"),
        F.round("error", 9).alias("error"),
        F.round("accuracy", 9).alias("accuracy"),
    )


@query(
    "best_threshold",
    f"{_SWEEP} SELECT step, {o.rounded('error', 9)} AS error FROM sweep "
    "ORDER BY sweep.error, step LIMIT 1",
)
def best_threshold(spark, sf_dir):
    best = evaluate.best_threshold(
        evaluate.threshold_sweep(_scored(spark, sf_dir), "score", "binaryLabel")
    )
    return best.select("step", F.round("error", 9).alias("error"))


def _area(spark, value):
    return spark.createDataFrame([(float(value),)], "area double").select(
        F.round("area", 9).alias("area")
    )


@query(
    "auroc",
    f"WITH {o.LABELLED_VECTORS} SELECT round(area, 9) AS area FROM ("
    + o.ranked_area("labelled", "embedding[1]", "binaryLabel")
    + ")",
)
def auroc(spark, sf_dir):
    rows = labelled_vectors(spark, sf_dir).select(
        "binaryLabel", F.col("embedding")[0].alias("score")
    )
    return _area(spark, evaluate.area_under(rows, "score"))


@query(
    "auroc_ties",
    f"WITH {o.LABELLED} SELECT round(area, 9) AS area FROM ("
    + o.ranked_area("labelled", "acc_Chest_X", "binaryLabel")
    + ")",
)
def auroc_ties(spark, sf_dir):
    """A score of fifty values only: whole blocks of equal scores."""
    return _area(
        spark, evaluate.area_under(labelled_readings(spark, sf_dir), "acc_Chest_X")
    )


@query(
    "auroc_readings",
    f"WITH {o.LABELLED} SELECT round(area, 9) AS area FROM ("
    + o.ranked_area("labelled", "ecg_1", "binaryLabel")
    + ")",
)
def auroc_readings(spark, sf_dir):
    """A score of nearly as many values as rows, over several tasks."""
    return _area(spark, evaluate.area_under(labelled_readings(spark, sf_dir), "ecg_1"))


@query(
    "aupr_check",
    f"WITH {o.LABELLED_VECTORS}, points AS (SELECT embedding[1] AS s, sum(binaryLabel) AS p, "
    "count(*) AS c FROM labelled GROUP BY 1), curve AS (SELECT s, "
    "sum(p) OVER (ORDER BY s DESC) AS tp, sum(c) OVER (ORDER BY s DESC) AS called, "
    "sum(p) OVER () AS all_p FROM points), xy AS (SELECT s, tp / all_p AS recall, "
    "tp / called AS precision FROM curve), steps AS (SELECT recall, precision, "
    "coalesce(lag(recall) OVER (ORDER BY s DESC), 0.0) AS r0, "
    "coalesce(lag(precision) OVER (ORDER BY s DESC), precision) AS p0 FROM xy) "
    "SELECT round(sum((recall - r0) * (precision + p0) / 2), 9) AS area FROM steps",
)
def aupr(spark, sf_dir):
    rows = labelled_vectors(spark, sf_dir).select(
        "binaryLabel", F.col("embedding")[0].alias("score")
    )
    return _area(spark, evaluate.area_under(rows, "score", metric="areaUnderPR"))
