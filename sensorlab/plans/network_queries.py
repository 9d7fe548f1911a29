"""Queries over the random-hidden-layer networks.

The checking SQL solves the narrow fits itself.  Layers of smooth nodes that are
too wide for it are held against a narrower layer that it solves: its nodes are
the wide layer's first, so the wide fit can leave no more squares than it does.
Steps on one input are solved exactly, since their fit is the mean of each
interval.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorlab.functions.hashing import lattice
from sensorlab.operators import evaluate, prepare, tune
from sensorlab.operators.elm.layer import draw_layer, hidden_columns, linear_columns
from sensorlab.operators.elm.model import (
    ElmClassificationModel,
    ElmClassifier,
    ElmRegressor,
    score_activations,
    score_column,
    score_expression,
)
from sensorlab.operators.elm.solver import gram
from sensorlab.operators.features import cross_product
from sensorlab.operators.pinv import pseudo_inverse, row_product
from sensorlab.plans import oracles as o
from sensorlab.plans.jobs import (
    ONLINE_NODES,
    VELOCITIES,
    ElmJobParams,
    JobParams,
    run_elm,
    run_exploration,
    run_online_exploration,
)
from sensorlab.plans.registry import ORACLES, query, written_once
from sensorlab.schema import CHEST, LABEL
from sensorlab.session import scratch_path
from sensorlab.sources.adapters import labelled_readings, labelled_vectors, readings, vectors
from sensorlab.streaming.online import OnlineElm

# inputs are divided by this, or the hidden nodes saturate
SCALE = 50.0
NODES = 10
INPUTS = [f"({c} / 50.0)" for c in CHEST]
VECTOR_INPUTS = ["embedding[1]", "embedding[2]", "embedding[3]"]

# output weights given by rule, for scoring apart from any fit
BETA_START = 100000


def _inputs():
    return [F.col(c) / SCALE for c in CHEST]


def _rows(spark, sf_dir, *keep):
    rows = labelled_readings(spark, sf_dir)
    return rows.select(F.array(*_inputs()).alias("features"), "binaryLabel", *keep)


def _vector_rows(spark, sf_dir, *keep):
    rows = labelled_vectors(spark, sf_dir)
    inputs = F.slice("embedding", 1, 3).alias("features")
    return rows.select("vec_id", inputs, "binaryLabel", *keep)


def _layer(name="tanh", nodes=NODES, features=3):
    return draw_layer(nodes, features, name, "arithmetic")


def _given_beta(nodes=NODES):
    return lattice(np.arange(BETA_START, BETA_START + nodes)) - 0.5


_HIDDEN = ", ".join(
    [o.LABELLED, o.layer(NODES, 3), o.hidden("labelled", ["subject", "binaryLabel"], INPUTS, NODES, "tanh")]
)


@query(
    "random_layer",
    "WITH "
    + ", ".join(
        [o.LABELLED, o.layer(NODES, 3), o.hidden("labelled", ["subject"], INPUTS, NODES, "linear")]
    )
    + " SELECT subject, "
    + ", ".join(f"{o.rounded(f'sum(h{i})', 6)} AS z{i}" for i in range(1, NODES + 1))
    + " FROM hidden GROUP BY subject",
)
def random_layer(spark, sf_dir):
    """Summed inputs of the drawn nodes over all readings, per subject."""
    rows = labelled_readings(spark, sf_dir)
    z = linear_columns(_inputs(), _layer())
    return rows.groupBy("subject").agg(
        *[F.round(F.sum(c), 6).alias(f"z{i + 1}") for i, c in enumerate(z)]
    )


@query(
    "hidden_layer",
    f"WITH {_HIDDEN} SELECT subject, "
    + ", ".join(f"{o.rounded(f'sum(h{i})', 6)} AS h{i}" for i in range(1, NODES + 1))
    + " FROM hidden GROUP BY subject",
)
def hidden_layer(spark, sf_dir):
    rows = labelled_readings(spark, sf_dir)
    h = hidden_columns(_inputs(), _layer())
    return rows.groupBy("subject").agg(
        *[F.round(F.sum(c), 6).alias(f"h{i + 1}") for i, c in enumerate(h)]
    )


_PAIRS = [(i, j) for i in range(NODES) for j in range(i, NODES)]


@query(
    "elm_gram",
    f"WITH {_HIDDEN}, sums AS (SELECT "
    + ", ".join(f"sum(h{i + 1} * h{j + 1}) AS g{i}_{j}" for i, j in _PAIRS)
    + ", "
    + ", ".join(f"sum(h{i + 1} * binaryLabel) AS y{i}" for i in range(NODES))
    + " FROM hidden) "
    + " UNION ALL ".join(
        [f"SELECT {i} AS i, {j} AS j, {o.rounded(f'g{i}_{j}', 5)} AS value FROM sums" for i, j in _PAIRS]
        + [f"SELECT {i}, -1, {o.rounded(f'y{i}', 5)} FROM sums" for i in range(NODES)]
    ),
)
def elm_gram(spark, sf_dir):
    rows = labelled_readings(spark, sf_dir)
    moments = gram(rows, hidden_columns(_inputs(), _layer()), F.col("binaryLabel"))
    return moments.select("i", "j", F.round("value", 5).alias("value"))


def _given_scores(act: str) -> str:
    return ", ".join(
        [
            o.LABELLED,
            o.layer(NODES, 3),
            o.lattice(str(BETA_START), NODES, "given"),
            o.hidden("labelled", ["subject", "binaryLabel"], INPUTS, NODES, act, f"hidden_{act}"),
            f"scored_{act} AS (SELECT subject, binaryLabel, "
            + " + ".join(f"(given.w[{i}] - 0.5) * h{i}" for i in range(1, NODES + 1))
            + f" AS t FROM hidden_{act}, given)",
        ]
    )


@query(
    "elm_score",
    f"WITH {_given_scores('tanh')} SELECT subject, {o.rounded('sum(t)', 6)} AS total, "
    f"{o.rounded('sum(t * t)', 6)} AS squares FROM scored_tanh GROUP BY subject",
)
def elm_score(spark, sf_dir):
    rows = _rows(spark, sf_dir, "subject")
    scored = rows.withColumn("t", score_column(F.col("features"), _layer(), _given_beta()))
    return scored.groupBy("subject").agg(
        F.round(F.sum("t"), 6).alias("total"), F.round(F.sum(F.col("t") * F.col("t")), 6).alias("squares")
    )


@query("elm_score_expression", ORACLES["elm_score"])
def elm_score_expression(spark, sf_dir):
    """The same scores as one expression, without a Python worker."""
    rows = _rows(spark, sf_dir, "subject")
    scored = rows.withColumn("t", score_expression(F.col("features"), _layer(), _given_beta()))
    return scored.groupBy("subject").agg(
        F.round(F.sum("t"), 6).alias("total"), F.round(F.sum(F.col("t") * F.col("t")), 6).alias("squares")
    )


_THREE = ["sigmoid", "tanh", "sin"]


def _three_sql() -> str:
    parts = [o.LABELLED, o.layer(NODES, 3), o.lattice(str(BETA_START), NODES, "given")]
    sums = []
    for act in _THREE:
        parts.append(o.hidden("labelled", ["subject"], INPUTS, NODES, act, f"hidden_{act}"))
        t = " + ".join(f"(given.w[{i}] - 0.5) * h{i}" for i in range(1, NODES + 1))
        parts.append(
            f"{act}_sum AS (SELECT subject, {o.rounded(f'sum({t})', 6)} AS {act} "
            f"FROM hidden_{act}, given GROUP BY subject)"
        )
        sums.append(f"{act}_sum")
    joined = sums[0] + "".join(f" JOIN {s} USING (subject)" for s in sums[1:])
    return f"WITH {', '.join(parts)} SELECT subject, {', '.join(_THREE)} FROM {joined}"


@query("elm_score_all_activations", _three_sql())
def elm_score_all_activations(spark, sf_dir):
    betas = {name: _given_beta() for name in _THREE}
    rows = _rows(spark, sf_dir, "subject")
    scored = rows.withColumn("t", score_activations(F.col("features"), _layer(), betas))
    return scored.groupBy("subject").agg(
        *[F.round(F.sum(f"t.{name}"), 6).alias(name) for name in _THREE]
    )


@query(
    "elm_predict",
    f"WITH {_given_scores('tanh')} SELECT binaryLabel, "
    "CAST(CASE WHEN t > 0 THEN 1 ELSE 0 END AS DOUBLE) AS prediction, count(*) AS count "
    "FROM scored_tanh GROUP BY ALL",
)
def elm_predict(spark, sf_dir):
    model = ElmClassificationModel(_layer(), _given_beta())
    return evaluate.confusion_counts(model.transform(_rows(spark, sf_dir)))


# --- fits ------------------------------------------------------------------


def _fit_sql(act: str) -> str:
    return (
        o.fitted_network(o.LABELLED, "labelled", ["subject", "binaryLabel"], INPUTS, NODES, act)
        + f"SELECT subject, count(*) AS rows, {o.rounded('avg(t)', 5)} AS fitted FROM scored "
        "GROUP BY subject"
    )


def _fitted_means(model, rows):
    return rows.withColumn("t", model.score(rows)).groupBy("subject").agg(
        F.count("*").alias("rows"), F.round(F.avg("t"), 5).alias("fitted")
    )


def _classifier(act="tanh", nodes=NODES):
    return ElmClassifier(activationFunc=act, hiddenNodes=nodes, init="arithmetic")


def _fit_query(name: str, act: str):
    @query(name, _fit_sql(act))
    def run(spark, sf_dir):
        rows = _rows(spark, sf_dir, "subject")
        return _fitted_means(_classifier(act).fit(rows), rows)

    return run


_fit_query("elm_fit_check", "tanh")
_fit_query("elm_fit_sin", "sin")
_fit_query("elm_fit_radbas", "radbas")
_fit_query("elm_fit_sigmoid", "sigmoid")


# nodes of the narrow fit that a wide one is held against
NARROW = 16


def _wide_sql(act) -> str:
    """Squares that the narrow fit leaves; the wide one must leave fewer, and as many
    positive as negative residuals in sum."""
    fitted = o.fitted_network(o.LABELLED, "labelled", ["binaryLabel"], INPUTS, NARROW, act)
    return (
        f"{fitted} SELECT count(*) AS rows, {o.rounded('avg(pow(t - binaryLabel, 2))', 7)} AS narrow, "
        "TRUE AS wide_leaves_less, 0.0::DOUBLE AS mean_residual FROM scored"
    )


def wide_check(spark, sf_dir, act, nodes, **settings):
    rows = _rows(spark, sf_dir)
    wide, narrow = (
        ElmClassifier(activationFunc=act, hiddenNodes=n, init="arithmetic", **more).fit(rows)
        for n, more in ((nodes, settings), (NARROW, {}))
    )
    scored = rows.withColumn("w", wide.score(rows)).withColumn("n", narrow.score(rows))
    label = F.col("binaryLabel")
    left = scored.agg(
        F.count("*").alias("rows"),
        F.avg((F.col("n") - label) ** 2).alias("narrow"),
        F.avg((F.col("w") - label) ** 2).alias("wide"),
        F.avg(F.col("w") - label).alias("mean"),
    )
    return left.select(
        "rows",
        F.round("narrow", 7).alias("narrow"),
        (F.col("wide") <= F.col("narrow") + 1e-9).alias("wide_leaves_less"),
        (F.round("mean", 6) + 0.0).alias("mean_residual"),
    )


def _wide_fit(name: str, act: str, nodes: int):
    @query(name, _wide_sql(act))
    def run(spark, sf_dir):
        return wide_check(spark, sf_dir, act, nodes)

    return run


_wide_fit("elm_normal_equations", "tanh", 100)
_wide_fit("elm_normal_equations_sigmoid", "sigmoid", 50)


def _vector_fit_sql() -> str:
    inputs = [f"embedding[{i}]" for i in range(1, 65)]
    fitted = o.fitted_network(
        o.LABELLED_VECTORS, "labelled", ["vec_id", "binaryLabel"], inputs, 40, "sigmoid"
    )
    return f"{fitted} SELECT vec_id, {o.rounded('t', 5)} AS fitted FROM scored"


@query("elm_normal_equations_vectors", _vector_fit_sql())
def elm_normal_equations_vectors(spark, sf_dir):
    """All 64 axes as features: the fitted output of every row."""
    rows = labelled_vectors(spark, sf_dir).select(
        "vec_id", F.col("embedding").alias("features"), "binaryLabel"
    )
    model = _classifier("sigmoid", 40).fit(rows)
    return rows.select("vec_id", F.round(model.score(rows), 5).alias("fitted"))


# regression: the square root of an amount, both scaled to [-1, 1]
_SCALED = (
    o.READINGS
    + ", roots AS (SELECT acc_Chest_X AS x, sqrt(acc_Chest_X) AS y FROM readings), scaled AS (SELECT "
    + ", ".join(
        f"(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())) * 2 - 1 AS {c}"
        for c in "xy"
    )
    + " FROM roots)"
)


def _regression_rows(spark, sf_dir):
    rows = readings(spark, sf_dir).select(
        F.col("acc_Chest_X").alias("x"), F.sqrt("acc_Chest_X").alias("y")
    )
    scaled = prepare.scale_symmetric(rows, ["x", "y"])
    return scaled.select(F.array("x").alias("features"), "y")


def _steps_sql() -> str:
    """Nodes that step on one input cut it into intervals; the fit is each one's mean."""
    active = " + ".join(f"h{i}" for i in range(1, 41))
    parts = [
        _SCALED,
        o.layer(40, 1),
        o.hidden("scaled", ["y"], ["x"], 40, "hardlim"),
        f"cut AS (SELECT y, CAST({active} AS BIGINT) AS active FROM hidden)",
    ]
    return (
        f"WITH {', '.join(parts)} SELECT active, count(*) AS rows, {o.rounded('avg(y)', 7)} AS lowest, "
        f"{o.rounded('avg(y)', 7)} AS highest FROM cut GROUP BY active"
    )


def steps_of(scored, layer):
    """Rows, and the least and greatest fitted value, by the number of active nodes."""
    active = sum(hidden_columns([F.col("features")[0]], layer))
    return scored.groupBy(active.cast("bigint").alias("active")).agg(
        F.count("*").alias("rows"),
        (F.round(F.min("prediction"), 7) + 0.0).alias("lowest"),
        (F.round(F.max("prediction"), 7) + 0.0).alias("highest"),
    )


@query("elm_regression_check", _steps_sql())
def elm_regression(spark, sf_dir):
    rows = _regression_rows(spark, sf_dir)
    model = ElmRegressor(
        labelCol="y", activationFunc="hardlim", hiddenNodes=40, init="arithmetic"
    ).fit(rows)
    return steps_of(model.transform(rows), model.layer)


def _train_online(spark, folder, schema, layer, target):
    """A network trained by a stream of a folder's files, in several micro-batches."""
    online = OnlineElm(spark, layer, scratch_path(spark, "online-state"), target=target)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)
    online.start(stream, scratch_path(spark, "online-checkpoint")).awaitTermination()
    return online


@query("elm_online_equals_batch", _fit_sql("tanh"))
def elm_online(spark, sf_dir):
    """Trained by a stream of the subjects' files."""
    folder = written_once(
        spark,
        sf_dir,
        "stream",
        lambda path: _rows(spark, sf_dir, "subject").write.partitionBy("subject").parquet(path),
    )
    schema = "features array<double>, binaryLabel double, subject bigint"
    online = _train_online(spark, folder, schema, _layer(), "binaryLabel")
    return _fitted_means(online.model(), _rows(spark, sf_dir, "subject"))


@query("elm_online_regression", _steps_sql())
def elm_online_regression(spark, sf_dir):
    rows = _regression_rows(spark, sf_dir)
    folder = written_once(
        spark,
        sf_dir,
        "stream-roots",
        lambda path: rows.repartitionByRange(6, "y").write.parquet(path),
    )
    layer = _layer("hardlim", 40, 1)
    online = _train_online(spark, folder, "features array<double>, y double", layer, "y")
    return steps_of(online.model(regression=True).transform(rows), layer)


@query("elm_save_load", _fit_sql("tanh"))
def elm_save_load(spark, sf_dir):
    rows = _rows(spark, sf_dir, "subject")
    path = scratch_path(spark, "model")
    _classifier().fit(rows).save(path)
    return _fitted_means(ElmClassificationModel.load(path), rows)


@query(
    "elm_auroc",
    o.fitted_network(o.LABELLED_VECTORS, "labelled", ["binaryLabel"], VECTOR_INPUTS, NODES, "tanh")
    + f"SELECT round(area, 6) AS area FROM ({o.ranked_area('scored', 't', 'binaryLabel')})",
)
def elm_auroc(spark, sf_dir):
    rows = _vector_rows(spark, sf_dir)
    predictions = _classifier().fit(rows).transform(rows)
    area = evaluate.area_under(predictions)
    return spark.createDataFrame([(area,)], "area double").select(F.round("area", 6).alias("area"))


# --- cross-validation ------------------------------------------------------

_POINTS = [("tanh", 10), ("tanh", 12), ("sin", 10), ("sin", 12)]
_FOLDS = 3


def _errors_sql(tables, inputs, key, points, threshold) -> str:
    """WITH list that ends in ``errors``: error and rows of every point on every fold, from
    a fit on the other folds."""
    fold = f"CAST(floor({o.knuth_twice(key)} * {_FOLDS} / 4294967296) AS INTEGER)"
    widest = max(n for _, n in points)
    parts = [tables, o.layer(widest, len(inputs)), f"folded AS (SELECT *, {fold} AS fold FROM labelled)"]
    errors = []
    for act in dict.fromkeys(a for a, _ in points):
        parts.append(
            o.hidden("folded", ["fold", "binaryLabel"], inputs, widest, act, f"hidden_{act}")
        )
    for (act, nodes), fold in product(points, range(_FOLDS)):
        name = f"{act}{nodes}_{fold}"
        parts.append(
            o.normal_rows(f"hidden_{act}", nodes, "binaryLabel", f"eq_{name}", f"fold <> {fold}")
        )
        parts.append(o.gauss_jordan(f"eq_{name}", nodes, f"beta_{name}"))
        t = o.weighted(nodes, f"beta_{name}.b")
        errors.append(
            f"SELECT '{act}' AS activation, {nodes} AS hidden_nodes, "
            f"avg(CASE WHEN ({t} > {threshold}) <> (binaryLabel > 0.5) THEN 1.0 ELSE 0.0 END) AS e, "
            f"count(*) AS n FROM hidden_{act}, beta_{name} WHERE fold = {fold}"
        )
    parts.append(f"errors AS ({' UNION ALL '.join(errors)})")
    return f"WITH RECURSIVE {', '.join(parts)} "


def _grid_sql() -> str:
    return (
        f"{_errors_sql(o.LABELLED_VECTORS, VECTOR_INPUTS, 'vec_id', _POINTS, 0.5)}"
        f"SELECT activation, hidden_nodes, {o.rounded('avg(e)', 9)} AS error, "
        "CAST(sum(n) AS BIGINT) AS rows FROM errors GROUP BY activation, hidden_nodes"
    )


@query("elm_grid_check", _grid_sql())
def elm_grid(spark, sf_dir):
    rows = prepare.with_fold(_vector_rows(spark, sf_dir), "vec_id", _FOLDS)
    table = tune.elm_cross_validate(rows, _POINTS, _FOLDS, init="arithmetic", threshold=0.5)
    return table.select("activation", "hidden_nodes", F.round("error", 9).alias("error"), "rows")


def _production_sql() -> str:
    """Errors of the narrow points; of the wide ones their rows only. Ranks follow errors."""
    points = tune.elm_grid_points()
    narrow = [(a, n) for a, n in points if n == NODES]
    listed = ", ".join(f"({i}, '{a}', {n})" for i, (a, n) in enumerate(points))
    return (
        f"{_errors_sql(o.LABELLED, INPUTS, 'session_id', narrow, 0)}"
        "SELECT CAST(point AS INTEGER) AS point, p.activation, CAST(p.hidden_nodes AS INTEGER) AS hidden_nodes, "
        f"{o.rounded('error', 9)} AS narrow_error, (SELECT count(*) FROM labelled) AS rows, "
        f"TRUE AS ranked FROM (VALUES {listed}) p(point, activation, hidden_nodes) LEFT JOIN "
        "(SELECT activation, hidden_nodes, avg(e) AS error FROM errors GROUP BY 1, 2) USING (activation, hidden_nodes)"
    )


@query("elm_grid_production", _production_sql())
def elm_grid_production(spark, sf_dir):
    """The job's whole grid on readings; folds by session. Networks drawn by arithmetic."""
    rows = prepare.with_fold(_rows(spark, sf_dir, "session_id"), "session_id", tune.ELM_FOLDS)
    table = tune.elm_cross_validate(rows, tune.elm_grid_points(), init="arithmetic")
    # a row per grid point: whether its rank is that of its error, the first of equals
    ordered = Window.orderBy("rank")
    error, before = F.round("error", 12), F.round(F.lag("error").over(ordered), 12)
    later = (before == error) & (F.lag("point").over(ordered) < F.col("point"))
    return table.select(
        "point",
        "activation",
        "hidden_nodes",
        F.when(F.col("hidden_nodes") == NODES, F.round("error", 9)).alias("narrow_error"),
        "rows",
        (F.col("rank").eqNullSafe(1) | (before < error) | later).alias("ranked"),
    )


# --- pseudo-inverse --------------------------------------------------------

_AXES = 64


def _pinv_sql() -> str:
    x = [f"embedding[{i + 1}]" for i in range(_AXES)]
    sums = [f"sum({a} * {b}) AS g{i}_{j}" for i, a in enumerate(x) for j, b in enumerate(x)]
    lists = []
    for i in range(_AXES):
        cells = [f"g{i}_{j}" for j in range(_AXES)]
        cells += ["1.0::DOUBLE" if i == j else "0.0::DOUBLE" for j in range(_AXES)]
        lists.append(f"SELECT {i + 1} AS i, [{', '.join(cells)}] AS r FROM sums")
    values = " + ".join(f"b[{j + 1}] * {x[j]}" for j in range(_AXES))
    return (
        f"WITH RECURSIVE {o.VECTORS}, sums AS (SELECT {', '.join(sums)} FROM vectors), "
        f"augmented AS ({' UNION ALL '.join(lists)}), "
        f"{o.gauss_jordan('augmented', _AXES, 'inverse', _AXES)} "
        f"SELECT vec_id, CAST(i AS INTEGER) AS axis, {o.rounded(values, 9)} AS value "
        "FROM vectors, inverse"
    )


@query("svd_pseudo_inverse_check", _pinv_sql())
def svd_pseudo_inverse(spark, sf_dir):
    """Each row's column of the pseudo-inverse of all vectors."""
    rows = vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("features"))
    inverse = pseudo_inverse(rows, _AXES)
    return inverse.select("vec_id", F.posexplode("pinv").alias("axis", "value")).select(
        "vec_id", (F.col("axis") + 1).alias("axis"), F.round("value", 9).alias("value")
    )


@query(
    "svd_reconstruction",
    f"WITH {o.VECTORS} SELECT vec_id, unnest(range(64)) AS axis, "
    "unnest([round(v, 7) + 0.0 for v in embedding]) AS value FROM vectors",
)
def svd_reconstruction(spark, sf_dir):
    """A times A+ times A gives back A, on all 64 axes."""
    rows = vectors(spark, sf_dir)
    product_ = cross_product(pseudo_inverse(rows, 64, "embedding"), "pinv", "embedding").collect()
    near_identity = np.zeros((64, 64))
    for cell in product_:
        near_identity[cell["i"], cell["j"]] = cell["value"]
    rebuilt = rows.withColumn("rebuilt", row_product(F.col("embedding"), near_identity))
    cells = rebuilt.select("vec_id", F.posexplode("rebuilt").alias("axis", "value"))
    return cells.select(
        "vec_id",
        F.col("axis").cast("bigint").alias("axis"),
        (F.round("value", 7) + 0.0).alias("value"),
    )


# --- jobs ------------------------------------------------------------------


def _job_sql() -> str:
    """Sizes and errors of the job with its narrow network; the tuned one's follow from
    scores above 0, as in the grid's query."""
    test = f"{o.knuth('session_id', 12345)} < {int(0.6 * 2**32)}"
    fold = f"CAST(floor({o.knuth_twice('session_id', 12345)} * {tune.ELM_FOLDS} / 4294967296) AS INTEGER)"
    fitted = o.fitted_network(
        o.LABELLED, "labelled", ["session_id", "binaryLabel"], INPUTS, NODES, "tanh",
        train=f"NOT ({test})",
    )
    wrong = "avg(CASE WHEN (t > 0) <> (binaryLabel > 0.5) THEN 1.0 ELSE 0.0 END)"
    rows = ["SELECT 'data' AS stage, 'samples' AS metric, count(*)::DOUBLE AS value FROM scored"]
    for stage, where in (("train", f"NOT ({test})"), ("test", test), ("tuned", test)):
        rows.append(f"SELECT '{stage}', 'rows', count(*)::DOUBLE FROM scored WHERE {where}")
        rows.append(
            f"SELECT '{stage}', 'misclassification', {o.rounded(wrong, 9)} FROM scored "
            f"WHERE {where}"
        )
    rows.append(f"SELECT 'tune', 'best hidden nodes', {tune.ELM_GRID_NODES[0]}::DOUBLE")
    rows.append(
        f"SELECT 'tune', 'best misclassification', {o.rounded('avg(e)', 9)} FROM (SELECT {wrong} AS e "
        f"FROM scored WHERE {test} GROUP BY {fold})"
    )
    return fitted + " UNION ALL ".join(rows)


def _sizes_and_errors(report):
    known = ["samples", "rows", "misclassification", "best hidden nodes", "best misclassification"]
    return report.where(F.col("metric").isin(known)).select(
        "stage", "metric", F.round("value", 9).alias("value")
    )


@query("job_report", _job_sql())
def job_report(spark, sf_dir):
    """What the network job reports of sizes and errors, with a narrow network."""
    params = ElmJobParams(scale=SCALE, key="session_id", hiddenNodes=NODES, init="arithmetic")
    return _sizes_and_errors(run_elm(spark, readings(spark, sf_dir), params).report)


@query("job_elm", _job_sql())
def job_elm(spark, sf_dir):
    """The same of the job as it stands."""
    params = ElmJobParams(scale=SCALE, key="session_id")
    return _sizes_and_errors(run_elm(spark, readings(spark, sf_dir), params).report)


#: Readings whose activity follows the chest channels, with noise from another channel.
SIGNAL = (
    "0.2 * (acc_Chest_X - 25.5) + 2 * sin(acc_Chest_Y) - 0.6 * (acc_Chest_Z - 4) "
    "+ 0.8 * (acc_Arm_X % 7 - 3) > 0"
)
SIGNAL_POINTS = (("tanh", 10), ("tanh", 12), ("sin", 10), ("sin", 12))


def signal_readings(spark, sf_dir):
    """All readings, with a code of 5 or 1 in place of each code above 0."""
    rows = readings(spark, sf_dir)
    code = F.when(F.col(LABEL) > 0, F.when(F.expr(SIGNAL), 5.0).otherwise(1.0)).otherwise(F.col(LABEL))
    return rows.withColumn(LABEL, code)


def _signal_sql() -> str:
    """The whole report: two fits, the grid on the test part, and the best point's fit on it."""
    test = f"{o.knuth('session_id', 12345)} < {int(0.6 * 2**32)}"
    fold = f"CAST(floor({o.knuth_twice('session_id', 12345)} * {tune.ELM_FOLDS} / 4294967296) AS INTEGER)"
    parts = [
        o.LABELLED,
        f"signal AS (SELECT session_id, CASE WHEN {SIGNAL} THEN 1.0::DOUBLE ELSE 0.0 END AS binaryLabel, "
        f"{', '.join(CHEST)}, {test} AS is_test, {fold} AS fold FROM labelled)",
        o.layer(12, len(INPUTS)),
    ]
    keep = ["is_test", "fold", "binaryLabel"]
    for act in ("tanh", "sin"):
        parts.append(o.hidden("signal", keep, INPUTS, 12, act, f"hidden_{act}"))

    def fit(name: str, act: str, nodes: int, where: str) -> str:
        parts.append(o.normal_rows(f"hidden_{act}", nodes, "binaryLabel", f"eq_{name}", where))
        parts.append(o.gauss_jordan(f"eq_{name}", nodes, f"beta_{name}"))
        return o.weighted(nodes, f"beta_{name}.b")

    def scored(name: str, act: str, t: str, where: str) -> str:
        return f"SELECT binaryLabel, {t} AS t FROM hidden_{act}, beta_{name} WHERE {where}"

    wrong = "avg(CASE WHEN (t > 0.5) <> (binaryLabel > 0.5) THEN 1.0 ELSE 0.0 END)"
    t = fit("main", "tanh", NODES, "NOT is_test")
    tables = {"train": scored("main", "tanh", t, "NOT is_test"), "test": scored("main", "tanh", t, "is_test")}
    errors = []
    for p, (act, nodes) in enumerate(SIGNAL_POINTS):
        for f in range(tune.ELM_FOLDS):
            own = fit(f"p{p}_{f}", act, nodes, f"is_test AND fold <> {f}")
            held = scored(f"p{p}_{f}", act, own, f"is_test AND fold = {f}")
            errors.append(f"SELECT {p} AS point, {wrong} AS e FROM ({held})")
    parts.append(
        f"errors AS (SELECT point, avg(e) AS error FROM ({' UNION ALL '.join(errors)}) GROUP BY point)"
    )
    listed = ", ".join(f"({p}, '{a}', {n})" for p, (a, n) in enumerate(SIGNAL_POINTS))
    parts.append(
        f"best AS (SELECT * FROM errors JOIN (VALUES {listed}) v(point, activation, hidden_nodes) USING (point) "
        "ORDER BY round(error, 12), point LIMIT 1)"
    )
    whole = []
    for p, (act, nodes) in enumerate(SIGNAL_POINTS):
        own = fit(f"w{p}", act, nodes, "is_test")
        whole.append(f"SELECT w.* FROM ({scored(f'w{p}', act, own, 'is_test')}) w, best WHERE point = {p}")
    tables["tuned"] = " UNION ALL ".join(whole)
    rows = ["SELECT 'data' AS stage, 'samples' AS metric, '' AS note, count(*)::DOUBLE AS value FROM signal"]
    for stage, table in tables.items():
        parts.append(f"{stage} AS ({table})")
        rows += [
            f"SELECT '{stage}', 'rows', '', count(*)::DOUBLE FROM {stage}",
            f"SELECT '{stage}', 'misclassification', '', {o.rounded(wrong, 9)} FROM {stage}",
            f"SELECT '{stage}', 'auroc', '', {o.rounded('area', 6)} FROM ({o.ranked_area(stage, 't', 'binaryLabel')})",
        ]
    rows += [
        "SELECT 'tune', 'best hidden nodes', activation, hidden_nodes::DOUBLE FROM best",
        f"SELECT 'tune', 'best misclassification', '', {o.rounded('error', 9)} FROM best",
    ]
    rows += [f"SELECT 'grid', 'error', '{a} {n}', {o.rounded('error', 9)} FROM errors WHERE point = {p}" for p, (a, n) in enumerate(SIGNAL_POINTS)]
    return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query("job_elm_signal", _signal_sql())
def job_elm_signal(spark, sf_dir):
    """All that the network job reports but its timings, and its grid, on readings with a signal."""
    params = ElmJobParams(
        scale=SCALE, key="session_id", hiddenNodes=NODES, init="arithmetic",
        decisionThreshold=0.5, points=SIGNAL_POINTS,
    )
    result = run_elm(spark, signal_readings(spark, sf_dir), params)
    report = result.report.where(~F.col("metric").endswith("seconds")).select(
        "stage",
        "metric",
        F.coalesce("note", F.lit("")).alias("note"),
        F.when(F.col("metric") == "auroc", F.round("value", 6)).otherwise(F.round("value", 9)).alias("value"),
    )
    grid = result.grid.select(
        F.lit("grid").alias("stage"),
        F.lit("error").alias("metric"),
        F.concat_ws(" ", "activation", "hidden_nodes").alias("note"),
        F.round("error", 9).alias("value"),
    )
    return report.unionByName(grid)


def _exploration_sql() -> str:
    labelled, unlabelled = f"{LABEL} > 0", f"{LABEL} = 0"
    speeds = []
    for name, (x, y, z) in VELOCITIES.items():
        speed = f"sqrt({' + '.join(f'pow({c} * 0.02, 2)' for c in (x, y, z))})"
        speeds.append(
            f"SELECT 'data', 'mean velocity', '{name}', {o.rounded(f'avg({speed})', 6)} FROM labelled"
        )
    online = [
        f"SELECT 'online {name}', 'rows', '{nodes} nodes', count(*)::DOUBLE FROM labelled"
        for name in ("channels", "velocities", "scaled velocities")
        for nodes in ONLINE_NODES
    ]
    rows = [
        "SELECT 'data' AS stage, 'all rows' AS metric, '' AS note, count(*)::DOUBLE AS value FROM readings",
        f"SELECT 'data', 'unlabelled rows', '', count(*)::DOUBLE FROM readings WHERE {unlabelled}",
        f"SELECT 'data', 'labelled rows', '', count(*)::DOUBLE FROM readings WHERE {labelled}",
        *speeds,
        *online,
    ]
    return f"WITH {o.LABELLED} {' UNION ALL '.join(rows)}"


@query("job_exploration", _exploration_sql())
def job_exploration(spark, sf_dir):
    """Sizes, speeds and the rows that the online networks have seen; the networks' own
    figures and the binomial model have queries and tests of their own."""
    report = run_exploration(
        spark, readings(spark, sf_dir), JobParams(scale=SCALE, key="session_id")
    ).report
    known = (F.col("stage") == "data") | (F.col("stage").startswith("online") & (F.col("metric") == "rows"))
    return report.where(known).select(
        "stage",
        "metric",
        F.coalesce("note", F.lit("")).alias("note"),
        F.round("value", 6).alias("value"),
    )


def _online_sql() -> str:
    """Errors of 10-node networks on channels, velocities, and velocities scaled to [-1, 1]."""
    speed = {
        name: f"sqrt({' + '.join(f'pow({c} * 0.02, 2)' for c in axes)})" for name, axes in VELOCITIES.items()
    }
    scaled = ", ".join(
        f"2 * ({v} - min({v}) OVER ()) / (max({v}) OVER () - min({v}) OVER ()) - 1 AS s_{v}" for v in VELOCITIES
    )
    parts = [
        o.LABELLED,
        f"signal AS (SELECT CASE WHEN {SIGNAL} THEN 1.0::DOUBLE ELSE 0.0 END AS binaryLabel, {', '.join(CHEST)}, "
        f"{', '.join(f'{e} AS {v}' for v, e in speed.items())} FROM labelled)",
        f"inputs AS (SELECT *, {scaled} FROM signal)",
        o.layer(NODES, 3),
    ]
    sets = {
        "channels": INPUTS,
        "velocities": list(VELOCITIES),
        "scaled velocities": [f"s_{v}" for v in VELOCITIES],
    }
    rows = []
    for i, (name, inputs) in enumerate(sets.items()):
        parts += [
            o.hidden("inputs", ["binaryLabel"], inputs, NODES, "sigmoid", f"hidden{i}"),
            o.normal_rows(f"hidden{i}", NODES, "binaryLabel", f"eq{i}"),
            o.gauss_jordan(f"eq{i}", NODES, f"beta{i}"),
            f"scored{i} AS (SELECT binaryLabel, {o.weighted(NODES, f'beta{i}.b')} AS t FROM hidden{i}, beta{i})",
        ]
        wrong = "avg(CASE WHEN (t > 0.5) <> (binaryLabel > 0.5) THEN 1.0 ELSE 0.0 END)"
        rows.append(f"SELECT 'online {name}' AS stage, 'rows' AS metric, count(*)::DOUBLE AS value FROM scored{i}")
        rows.append(f"SELECT 'online {name}', 'train error', {o.rounded(wrong, 4)} FROM scored{i}")
    return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query("exploration_online", _online_sql())
def exploration_online(spark, sf_dir):
    """Rows and training errors of the exploration's online networks of 10 nodes, on readings with a signal."""
    report = run_online_exploration(
        spark, signal_readings(spark, sf_dir), SCALE, sizes=(NODES,), init="arithmetic"
    )
    return report.where(~F.col("metric").endswith("seconds")).select(
        "stage", "metric", F.when(F.col("metric") == "rows", F.col("value")).otherwise(F.round("value", 4)).alias("value")
    )
