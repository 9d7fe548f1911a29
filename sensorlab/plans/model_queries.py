"""Queries over linear models and principal components.

A logistic fit without penalty is where fitted probabilities and labels have
the same moment with every feature; the SQL computes the labels' side from the
tables, and for the coefficients runs Newton's method itself.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sensorlab.functions.labels import above
from sensorlab.operators import (
    binomial,
    components,
    evaluate,
    features,
    linear,
    penalty_grid,
    prepare,
    tune,
)
from sensorlab.plans import oracles as o
from sensorlab.plans.jobs import LogisticJobParams, run_logistic, run_pca_logistic
from sensorlab.plans.registry import query
from sensorlab.schema import CHANNELS, CHEST, GLM_FEATURES, LOGISTIC_FEATURES
from sensorlab.session import kept
from sensorlab.sources.adapters import labelled_readings, labelled_vectors, readings, vectors

AXES = [f"x{i + 1}" for i in range(64)]
TIGHT = linear.LogisticParams(tol=1e-12, maxIter=200)


def _axes(count: int) -> str:
    return ", ".join(f"embedding[{i + 1}] AS x{i + 1}" for i in range(count))


def _vector_features(spark, sf_dir, count=64):
    names = AXES[:count]
    rows = labelled_vectors(spark, sf_dir).select(
        "vec_id", "binaryLabel", *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)]
    )
    return features.assemble(rows, names)


def _moment_sql(names: list[str]) -> str:
    """Per feature, the mean of label times feature; and that of residual times
    feature, which a fit without penalty makes zero."""
    cells = [o.rounded("avg(binaryLabel)", 9)]
    cells += [o.rounded(f"avg(binaryLabel * {n})", 9) for n in names]
    return (
        f"WITH {o.LABELLED_VECTORS}, axes AS (SELECT binaryLabel, {_axes(len(names))} "
        f"FROM labelled) SELECT unnest({['one', *names]!r}) AS feature, "
        f"unnest([{', '.join(cells)}]) AS moment, 0.0::DOUBLE AS residual FROM axes"
    )


def _moments(scored, probability, names):
    label = F.col("binaryLabel")
    factors = {"one": F.lit(1.0), **{n: F.col(n) for n in names}}
    means = scored.agg(
        *[F.avg(label * x).alias(f"m_{n}") for n, x in factors.items()],
        *[F.avg((probability - label) * x).alias(f"r_{n}") for n, x in factors.items()],
    )
    structs = [
        F.struct(
            F.lit(n).alias("feature"),
            F.round(f"m_{n}", 9).alias("moment"),
            F.round(f"r_{n}", 5).alias("residual"),
        )
        for n in factors
    ]
    return means.select(F.inline(F.array(*structs)))


@query("logistic_fit_check", _moment_sql(AXES))
def logistic_fit(spark, sf_dir):
    rows = _vector_features(spark, sf_dir)
    scored = linear.fit_logistic(rows, TIGHT).transform(rows)
    return _moments(scored, vector_to_array("probability")[1], AXES)


@query("glm_binomial_check", _moment_sql(AXES))
def glm_binomial(spark, sf_dir):
    rows = _vector_features(spark, sf_dir)
    scored = linear.fit_binomial(rows, tol=1e-12).transform(rows)
    return _moments(scored, F.col("probability"), AXES)


def _newton_parts(
    rows: str, names: list[str], steps: int = 8, tag: str = "", penalty: float = 0.0
) -> tuple[list[str], str]:
    """Newton's method on rows with columns y and ``names``, one solved linear
    system per step; and the name of its last weights.

    A penalty holds the weights of standardised features, as the estimator's does.
    """
    n = len(names) + 1
    x = ["1.0::DOUBLE", *names]
    parts = [f"{tag}w0 AS (SELECT [{', '.join(['0.0::DOUBLE'] * n)}] AS b)"]
    for step in range(steps):
        weights = f"{tag}w{step}"
        held = [f"{penalty} * count(*) * var_samp({a})" if penalty and i else "0" for i, a in enumerate(x)]
        parts.append(
            f"{tag}p{step} AS (SELECT {rows}.*, {weights}.b, {_probability(names)} AS p "
            f"FROM {rows}, {weights})"
        )
        sums = [
            f"sum(p * (1 - p) * {a} * {b}) + {held[i] if i == j else 0} AS g{i}_{j}"
            for i, a in enumerate(x)
            for j, b in enumerate(x)
        ]
        sums += [
            f"sum((y - p) * {a}) - {held[i]} * first(b[{i + 1}]) AS r{i}" for i, a in enumerate(x)
        ]
        parts.append(f"{tag}s{step} AS (SELECT {', '.join(sums)} FROM {tag}p{step})")
        lists = [
            f"SELECT {i + 1} AS i, [{', '.join([f'g{i}_{j}' for j in range(n)] + [f'r{i}'])}] AS r "
            f"FROM {tag}s{step}"
            for i in range(n)
        ]
        parts.append(f"{tag}e{step} AS ({' UNION ALL '.join(lists)})")
        parts.append(o.gauss_jordan(f"{tag}e{step}", n, f"{tag}d{step}"))
        moved = ", ".join(f"{weights}.b[{i + 1}] + {tag}d{step}.b[{i + 1}]" for i in range(n))
        parts.append(f"{tag}w{step + 1} AS (SELECT [{moved}] AS b FROM {weights}, {tag}d{step})")
    return parts, f"{tag}w{steps}"


def _newton(tables: str, rows: str, names: list[str], steps: int = 8) -> tuple[str, str]:
    parts, weights = _newton_parts(rows, names, steps)
    return f"WITH RECURSIVE {', '.join([tables, *parts])} ", weights


def _probability(names: list[str]) -> str:
    z = " + ".join(f"b[{i + 1}] * {v}" for i, v in enumerate(["1.0::DOUBLE", *names]))
    return f"(1 / (1 + exp(-({z}))))"


def _reading_tables(names: list[str]) -> str:
    return f"{o.LABELLED}, rows_ AS (SELECT binaryLabel AS y, {', '.join(names)} FROM labelled)"


def _reading_features(spark, sf_dir, names, *keep):
    rows = labelled_readings(spark, sf_dir).select("binaryLabel", *names, *keep)
    return features.assemble(rows, names)


def _coefficients_sql(names: list[str]) -> str:
    newton, weights = _newton(_reading_tables(names), "rows_", names)
    return (
        f"{newton} SELECT unnest({['(intercept)', *names]!r}) AS feature, "
        f"unnest([round(v, 6) + 0.0 for v in b]) AS coefficient FROM {weights}"
    )


def _cut_error_sql(names: list[str]) -> str:
    newton, weights = _newton(_reading_tables(names), "rows_", names)
    return (
        f"{newton} SELECT {o.rounded(f'avg(CASE WHEN ({_probability(names)} > 0.4) <> (y > 0.5) THEN 1.0 ELSE 0.0 END)', 5)} "
        f"AS error FROM rows_, {weights}"
    )


@query("glm_cut_error", _cut_error_sql(GLM_FEATURES))
def glm_cut_error(spark, sf_dir):
    """Error of class 1 above a probability of 0.4."""
    rows = _reading_features(spark, sf_dir, GLM_FEATURES)
    scored = linear.fit_binomial(rows, tol=1e-12).transform(rows)
    predicted = scored.withColumn("prediction", above("probability", linear.GLM_CUT))
    return evaluate.error_metrics(predicted).select(
        F.round("misclassification", 5).alias("error")
    )


def _summary_sql(names: list[str]) -> str:
    """Estimates, and their errors from the inverse of the information matrix."""
    newton, weights = _newton(_reading_tables(names), "rows_", names)
    n = len(names) + 1
    x = ["1.0::DOUBLE", *names]
    sums = ", ".join(
        f"sum(p * (1 - p) * {a} * {b}) AS g{i}_{j}" for i, a in enumerate(x) for j, b in enumerate(x)
    )
    lists = []
    for i in range(n):
        cells = [f"g{i}_{j}" for j in range(n)]
        cells += ["1.0::DOUBLE" if i == j else "0.0::DOUBLE" for j in range(n)]
        lists.append(f"SELECT {i + 1} AS i, [{', '.join(cells)}] AS r FROM information")
    parts = [
        f"fitted AS (SELECT rows_.*, {_probability(names)} AS p FROM rows_, {weights})",
        f"information AS (SELECT {sums} FROM fitted)",
        f"augmented AS ({' UNION ALL '.join(lists)})",
        o.gauss_jordan("augmented", n, "inverse", n),
        f"errors AS (SELECT i, {weights}.b[i] AS estimate, sqrt(inverse.b[i]) AS error "
        f"FROM inverse, {weights})",
    ]
    return (
        f"{newton.rstrip()}, {', '.join(parts)} SELECT ({['(intercept)', *names]!r})[i] AS feature, "
        f"{o.rounded('estimate', 6)} AS estimate, {o.rounded('error', 6)} AS std_error, "
        f"{o.rounded('estimate / error', 4)} AS z FROM errors"
    )


@query("glm_summary", _summary_sql(GLM_FEATURES))
def glm_summary(spark, sf_dir):
    """Estimate, standard error and z of every coefficient of the binomial model."""
    model = linear.fit_binomial(_reading_features(spark, sf_dir, GLM_FEATURES), tol=1e-12)
    table = linear.summary_table(model, GLM_FEATURES, spark)
    return table.select(
        "feature",
        F.round("estimate", 6).alias("estimate"),
        F.round("std_error", 6).alias("std_error"),
        F.round("z", 4).alias("z"),
    )


def _job_sql() -> str:
    """Sizes, coefficients and both metrics of the logistic job on readings."""
    names = LOGISTIC_FEATURES
    test = f"{o.knuth('session_id', 12345)} < {int(0.5 * 2**32)}"
    split = (
        f"{o.LABELLED}, split AS (SELECT binaryLabel AS y, {test} AS is_test, {', '.join(names)} "
        "FROM labelled), train AS (SELECT * FROM split WHERE NOT is_test)"
    )
    newton, weights = _newton(split, "train", names)
    parts = [
        f"scored AS (SELECT split.*, {_probability(names)} AS p FROM split, {weights})",
        "train_scored AS (SELECT * FROM scored WHERE NOT is_test)",
        "test_scored AS (SELECT * FROM scored WHERE is_test)",
    ]
    rows = [
        "SELECT 'data' AS stage, 'samples' AS metric, '' AS note, count(*)::DOUBLE AS value FROM split",
        "SELECT 'tuned', 'rows', '', count(*)::DOUBLE FROM split",
    ]
    for stage in ("train", "test"):
        wrong = "avg(CASE WHEN (p > 0.5) <> (y > 0.5) THEN 1.0 ELSE 0.0 END)"
        rows.append(f"SELECT '{stage}', 'rows', '', count(*)::DOUBLE FROM {stage}_scored")
        rows.append(
            f"SELECT '{stage}', 'misclassification', '', {o.rounded(wrong, 5)} FROM {stage}_scored"
        )
        rows.append(
            f"SELECT '{stage}', 'auroc', '', {o.rounded('area', 5)} "
            f"FROM ({o.ranked_area(f'{stage}_scored', 'p', 'y')})"
        )
    for i, name in enumerate(["", *names]):
        metric = "coefficient" if name else "intercept"
        rows.append(
            f"SELECT 'fit', '{metric}', '{name}', {o.rounded(f'b[{i + 1}]', 5)} FROM {weights}"
        )
    return f"{newton.rstrip()}, {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query("job_logistic", _job_sql())
def job_logistic(spark, sf_dir):
    """What the logistic job reports, but for its timings."""
    params = LogisticJobParams(key="session_id", model=TIGHT)
    report = run_logistic(spark, readings(spark, sf_dir), params).report
    # which point is best is checked by the grid's own query
    known = ~F.col("metric").endswith("seconds") & (
        ~F.col("stage").isin("tune", "tuned") | (F.col("metric") == "rows")
    )
    return report.where(known).select(
        "stage",
        "metric",
        F.coalesce("note", F.lit("")).alias("note"),
        F.round("value", 5).alias("value"),
    )


@query("logistic_coefficients", _coefficients_sql(LOGISTIC_FEATURES))
def logistic_coefficients(spark, sf_dir):
    model = linear.fit_logistic(_reading_features(spark, sf_dir, LOGISTIC_FEATURES), TIGHT)
    table = linear.coefficient_table(model, LOGISTIC_FEATURES, spark)
    return table.select("feature", F.round("coefficient", 6).alias("coefficient"))


def _components_sql(rows: str, names: list[str], k: int, where: str = "TRUE", steps: int = 200) -> list[str]:
    """Components c1 .. ck of the covariance, by power iteration with deflation, and their shares."""
    n = len(names)
    cells = [f"covar_samp({names[min(i, j)]}, {names[max(i, j)]})" for i in range(n) for j in range(n)]
    lists = ", ".join("[" + ", ".join(cells[i * n : (i + 1) * n]) + "]" for i in range(n))
    parts = [f"m1 AS (SELECT [{lists}] AS m FROM {rows} WHERE {where})"]
    for c in range(1, k + 1):
        parts.append(
            f"i{c} AS (SELECT 0 AS step, m, [sin({c} + range) for range in range({n})] AS v FROM m{c} "
            f"UNION ALL SELECT step + 1, m, [x / sqrt(list_dot_product(u, u)) for x in u] FROM "
            f"(SELECT step, m, [list_dot_product(r, v) for r in m] AS u FROM i{c} WHERE step < {steps}))"
        )
        parts.append(
            f"c{c} AS (SELECT v, m, list_dot_product(v, [list_dot_product(r, v) for r in m]) AS size "
            f"FROM i{c} WHERE step = {steps})"
        )
        parts.append(
            f"m{c + 1} AS (SELECT [[m[i][j] - size * v[i] * v[j] for j in range(1, {n + 1})] "
            f"for i in range(1, {n + 1})] AS m FROM c{c})"
        )
    return parts


def _pca_projection_sql() -> str:
    names = CHANNELS
    x = "[" + ", ".join(names) + "]"
    sums = [
        f"SELECT {c} AS component, {o.rounded(f'avg(pow(list_dot_product({x}, v), 2))', 3)} AS mean_square, "
        f"{o.rounded(f'stddev_samp(list_dot_product({x}, v))', 4)} AS spread FROM labelled, c{c}"
        for c in (1, 2, 3)
    ]
    parts = [o.LABELLED, *_components_sql("labelled", names, 3)]
    return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(sums)}"


@query("pca_project", _pca_projection_sql())
def pca_project(spark, sf_dir):
    """All channels of the readings on three components: mean square and spread of each."""
    rows = features.assemble(labelled_readings(spark, sf_dir), CHANNELS)
    projected = features.fit_pca(rows, 3).transform(rows).select(vector_to_array("pca").alias("pca"))
    cells = projected.select(F.posexplode("pca").alias("place", "x"))
    return cells.groupBy((F.col("place") + 1).cast("int").alias("component")).agg(
        F.round(F.avg(F.col("x") * F.col("x")), 3).alias("mean_square"),
        F.round(F.stddev_samp("x"), 4).alias("spread"),
    )


def _pca_job_sql() -> str:
    """The job on three components, but for its timings: sizes, shares and both metrics."""
    test = f"{o.knuth('session_id', 12345)} < {int(0.5 * 2**32)}"
    x = "[" + ", ".join(CHANNELS) + "]"
    split = [
        o.LABELLED,
        f"split AS (SELECT binaryLabel AS y, {test} AS is_test, {', '.join(CHANNELS)} FROM labelled)",
        *_components_sql("split", CHANNELS, 3, "NOT is_test"),
        "trace AS (SELECT list_sum([m[i][i] for i in range(1, 24)]) AS total FROM m1)",
        "projected AS (SELECT y, is_test, "
        + ", ".join(f"list_dot_product({x}, c{c}.v) / 1e4 AS x{c}" for c in (1, 2, 3))
        + " FROM split, c1, c2, c3)",
        "train AS (SELECT * FROM projected WHERE NOT is_test)",
    ]
    names = ["x1", "x2", "x3"]
    newton, weights = _newton_parts("train", names)
    split += [*newton, f"scored AS (SELECT projected.*, {_probability(names)} AS p FROM projected, {weights})"]
    rows = ["SELECT 'data' AS stage, 'samples' AS metric, '' AS note, count(*)::DOUBLE AS value FROM split"]
    for c in (1, 2, 3):
        rows.append(
            f"SELECT 'fit', 'explained variance', 'component {c}', {o.rounded('size / total', 5)} "
            f"FROM c{c}, trace"
        )
    for stage, where in (("train", "NOT is_test"), ("test", "is_test")):
        wrong = "avg(CASE WHEN (p > 0.5) <> (y > 0.5) THEN 1.0 ELSE 0.0 END)"
        area = o.ranked_area(f"(SELECT * FROM scored WHERE {where})", "p", "y")
        rows.append(f"SELECT '{stage}', 'rows', '', count(*)::DOUBLE FROM scored WHERE {where}")
        rows.append(f"SELECT '{stage}', 'misclassification', '', {o.rounded(wrong, 5)} FROM scored WHERE {where}")
        rows.append(f"SELECT '{stage}', 'auroc', '', {o.rounded('area', 5)} FROM ({area})")
    rows.append("SELECT 'tuned', 'rows', '', count(*)::DOUBLE FROM split WHERE is_test")
    return f"WITH RECURSIVE {', '.join(split)} {' UNION ALL '.join(rows)}"


@query("job_pca_logistic", _pca_job_sql())
def job_pca_logistic(spark, sf_dir):
    """What the job on three components of all channels reports, but for its timings."""
    params = LogisticJobParams(features=tuple(CHANNELS), key="session_id", model=TIGHT)
    report = run_pca_logistic(spark, readings(spark, sf_dir), params).report
    known = ~F.col("metric").endswith("seconds") & (
        ~F.col("stage").isin("tune", "tuned") | (F.col("metric") == "rows")
    )
    return report.where(known).select(
        "stage",
        "metric",
        F.coalesce("note", F.lit("")).alias("note"),
        F.round("value", 5).alias("value"),
    )


def _pca_fit_sql() -> str:
    names = ["x1", "x2", "x3"]
    x = "[" + ", ".join(CHANNELS) + "]"
    parts = [
        o.LABELLED,
        *_components_sql("labelled", CHANNELS, 3),
        "rows_ AS (SELECT subject, binaryLabel AS y, "
        + ", ".join(f"list_dot_product({x}, c{c}.v) / 1e4 AS x{c}" for c in (1, 2, 3))
        + " FROM labelled, c1, c2, c3)",
    ]
    newton, weights = _newton_parts("rows_", names)
    return (
        f"WITH RECURSIVE {', '.join([*parts, *newton])} SELECT subject, count(*) AS rows, "
        f"{o.rounded(f'avg({_probability(names)})', 6)} AS fitted, "
        f"{o.rounded(f'stddev_samp({_probability(names)})', 5)} AS spread FROM rows_, {weights} GROUP BY subject"
    )


@query("pca_logistic_check", _pca_fit_sql())
def pca_logistic(spark, sf_dir):
    """Fitted probabilities by subject of a fit on three components of all channels."""
    rows = labelled_readings(spark, sf_dir).select("subject", "binaryLabel", *CHANNELS)
    scored = linear.pca_logistic(CHANNELS, TIGHT).fit(rows).transform(rows)
    p = vector_to_array("probability")[1]
    return scored.withColumn("p", p).groupBy("subject").agg(
        F.count("*").alias("rows"),
        F.round(F.avg("p"), 6).alias("fitted"),
        F.round(F.stddev_samp("p"), 5).alias("spread"),
    )


_COVARIANCES = [(i, j) for i in range(64) for j in range(i, 64)]


def _covariance_sql() -> str:
    sums = ", ".join(f"covar_samp(embedding[{i + 1}], embedding[{j + 1}])" for i, j in _COVARIANCES)
    lists = [", ".join(f"{pair[k]}" for pair in _COVARIANCES) for k in (0, 1)]
    return (
        f"WITH {o.VECTORS}, c AS (SELECT [{sums}] AS cells FROM vectors), upper_half AS ("
        f"SELECT unnest([{lists[0]}]) AS i, unnest([{lists[1]}]) AS j, unnest(cells) AS cov FROM c) "
        f"SELECT i, j, {o.rounded('cov', 9)} AS cov FROM upper_half UNION ALL "
        f"SELECT j, i, {o.rounded('cov', 9)} FROM upper_half WHERE i < j"
    )


@query("pca_covariance", _covariance_sql())
def pca_covariance(spark, sf_dir):
    table = features.covariance(vectors(spark, sf_dir), "embedding")
    return table.select("i", "j", F.round("cov", 9).alias("cov"))


# eigenvalues of the symmetric 3 x 3 covariance by the trigonometric formula
_EIGEN = (
    f"WITH {o.LABELLED}, c AS (SELECT "
    + ", ".join(
        f"covar_samp({a}, {b}) AS c{i}{j}"
        for i, a in enumerate(CHEST)
        for j, b in enumerate(CHEST)
        if i <= j
    )
    + " FROM labelled), q AS (SELECT *, (c00 + c11 + c22) / 3 AS m FROM c), "
    "p AS (SELECT *, sqrt((pow(c00 - m, 2) + pow(c11 - m, 2) + pow(c22 - m, 2) "
    "+ 2 * (c01 * c01 + c02 * c02 + c12 * c12)) / 6) AS s FROM q), "
    "d AS (SELECT *, ((c00 - m) * ((c11 - m) * (c22 - m) - c12 * c12) "
    "- c01 * (c01 * (c22 - m) - c12 * c02) + c02 * (c01 * c12 - (c11 - m) * c02)) "
    "/ (s * s * s) / 2 AS h FROM p), "
    "e AS (SELECT *, acos(greatest(-1, least(1, h))) / 3 AS phi FROM d) "
)


@query(
    "pca_explained",
    _EIGEN
    + " UNION ALL ".join(
        f"SELECT {k + 1} AS component, {o.rounded(f'(m + 2 * s * cos(phi + {shift} * pi() / 3)) / (3 * m)', 9)} "
        "AS share FROM e"
        for k, shift in enumerate([0, 4, 2])
    ),
)
def pca_explained(spark, sf_dir):
    rows = features.assemble(labelled_readings(spark, sf_dir), CHEST)
    shares = features.fit_pca(rows, 3).explainedVariance.toArray().tolist()
    table = spark.createDataFrame(
        [(i + 1, share) for i, share in enumerate(shares)], "component int, share double"
    )
    return table.select("component", F.round("share", 9).alias("share"))


PENALTIES = [0.0, 0.01, 0.1]


def _grid_sql() -> str:
    """Points without penalty or with the squared one, past the first iteration limit."""
    names, folds = LOGISTIC_FEATURES, tune.LOGISTIC_FOLDS
    fold = f"CAST(floor({o.knuth_twice('session_id')} * {folds} / 4294967296) AS INTEGER)"
    parts = [
        o.LABELLED,
        f"folded AS (SELECT binaryLabel AS y, {fold} AS fold, {', '.join(names)} FROM labelled)",
    ]
    areas = []
    for f in range(folds):
        parts.append(f"train{f} AS (SELECT * FROM folded WHERE fold <> {f})")
        for i, penalty in enumerate(PENALTIES):
            newton, weights = _newton_parts(f"train{f}", names, 5, f"f{f}l{i}", penalty)
            scored = f"(SELECT y, {_probability(names)} AS p FROM folded, {weights} WHERE fold = {f})"
            parts += newton
            areas.append(f"SELECT {penalty}::DOUBLE AS reg_param, area FROM ({o.ranked_area(scored, 'p', 'y')})")
    parts.append(f"areas AS ({' UNION ALL '.join(areas)})")
    return (
        f"WITH RECURSIVE {', '.join(parts)} SELECT reg_param, elastic_net, CAST(max_iter AS INTEGER) AS max_iter, "
        f"{o.rounded('metric', 4)} AS metric FROM (SELECT reg_param, avg(area) AS metric FROM areas GROUP BY 1), "
        "(SELECT unnest([0.0::DOUBLE, 0.5, 1.0]) AS elastic_net), (SELECT unnest([50, 100]) AS max_iter) "
        "WHERE reg_param = 0 OR elastic_net = 0"
    )


@query("logistic_grid_check", _grid_sql())
def logistic_grid(spark, sf_dir):
    """The job's whole grid, five folds by key, in the job's shared scans; of its metrics those of this SQL."""
    rows = _reading_features(spark, sf_dir, LOGISTIC_FEATURES, "session_id")
    rows = prepare.with_fold(rows, "session_id", tune.LOGISTIC_FOLDS)
    with kept(rows.select("features", "binaryLabel", "fold")) as held:
        table = penalty_grid.cross_validate_penalties(held, tune.logistic_points(), tune.LOGISTIC_FOLDS)
    plain = (F.col("reg_param") == 0) | (F.col("elastic_net") == 0)
    return table.where(plain & (F.col("max_iter") > 10)).select(
        "reg_param", "elastic_net", "max_iter", F.round("metric", 4).alias("metric")
    )


def _whole_summary_sql() -> str:
    """The summary's sections from Newton's weights, the inverse information and plain sums."""
    names = GLM_FEATURES
    newton, weights = _newton(_reading_tables(names), "rows_", names)
    n = len(names) + 1
    x = ["1.0::DOUBLE", *names]
    sums = ", ".join(
        f"sum(p * (1 - p) * {a} * {b}) AS g{i}_{j}" for i, a in enumerate(x) for j, b in enumerate(x)
    )
    lists = []
    for i in range(n):
        cells = [f"g{i}_{j}" for j in range(n)]
        cells += ["1.0::DOUBLE" if i == j else "0.0::DOUBLE" for j in range(n)]
        lists.append(f"SELECT {i + 1} AS i, [{', '.join(cells)}] AS r FROM information")
    parts = [
        f"fitted AS (SELECT rows_.*, {_probability(names)} AS p FROM rows_, {weights})",
        f"information AS (SELECT {sums} FROM fitted)",
        f"augmented AS ({' UNION ALL '.join(lists)})",
        o.gauss_jordan("augmented", n, "inverse", n),
        f"errors AS (SELECT ({['(intercept)', *names]!r})[i] AS name, {weights}.b[i] AS estimate, "
        f"sqrt(inverse.b[i]) AS error FROM inverse, {weights})",
        "losses AS (SELECT y, -2 * ln(CASE WHEN y > 0.5 THEN p ELSE 1 - p END) AS d FROM fitted)",
        "residuals AS (SELECT CASE WHEN y > 0.5 THEN sqrt(d) ELSE -sqrt(d) END AS r FROM losses)",
        "sizes AS (SELECT count(*)::DOUBLE AS n, avg(y) AS m, sum(d) AS deviance, "
        "-2 * sum(ln(CASE WHEN y > 0.5 THEN share ELSE 1 - share END)) AS null_deviance "
        "FROM losses, (SELECT avg(y) AS share FROM losses))",
    ]
    rows = [
        f"SELECT 'estimate' AS section, name, {o.rounded('estimate', 6)} AS value FROM errors",
        f"SELECT 'std_error', name, {o.rounded('error', 6)} FROM errors",
        f"SELECT 'z', name, {o.rounded('estimate / error', 4)} FROM errors",
        f"SELECT 'fit', 'null deviance', {o.rounded('null_deviance', 4)} FROM sizes",
        "SELECT 'fit', 'null freedom', n - 1 FROM sizes",
        f"SELECT 'fit', 'residual deviance', {o.rounded('deviance', 4)} FROM sizes",
        f"SELECT 'fit', 'residual freedom', n - {n} FROM sizes",
        f"SELECT 'fit', 'aic', {o.rounded(f'deviance + 2 * {n}', 4)} FROM sizes",
    ]
    rows += [
        f"SELECT 'residual', '{name}', {o.rounded(f'quantile_disc(r, {q})', 4)} FROM residuals"
        for name, q in binomial.QUANTILES.items()
    ]
    return f"{newton.rstrip()}, {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query("glm_whole_summary", _whole_summary_sql())
def glm_whole_summary(spark, sf_dir):
    """Coefficients with errors and z, deviances, AIC and residual quantiles, by triangular factors."""
    rows = _reading_features(spark, sf_dir, GLM_FEATURES)
    with kept(rows) as held:
        table = binomial.fit_binomial_factor(held, tol=1e-12).summary(held, GLM_FEATURES)
    # p is too small to be told apart from 0 in SQL that has no error function
    digits = F.when(F.col("section").isin("estimate", "std_error"), F.round("value", 6)).otherwise(
        F.round("value", 4)
    )
    return table.where("section <> 'p'").withColumn("value", digits)


def _factor_components_sql() -> str:
    names = CHANNELS
    x = "[" + ", ".join(names) + "]"
    sums = [
        f"SELECT {c} AS component, {o.rounded('any_value(size)', 3)} AS variance, "
        f"{o.rounded('any_value(size) / any_value(total)', 9)} AS share, "
        f"{o.rounded(f'avg(pow(list_dot_product({x}, c{c}.v), 2))', 3)} AS mean_square "
        f"FROM labelled, c{c}, trace"
        for c in (1, 2, 3)
    ]
    parts = [
        o.LABELLED,
        *_components_sql("labelled", names, 3),
        "trace AS (SELECT list_sum([m[i][i] for i in range(1, 24)]) AS total FROM m1)",
    ]
    return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(sums)}"


@query("pca_factor", _factor_components_sql())
def pca_factor(spark, sf_dir):
    """Three components of all channels from a triangular factor: variance, share, mean square of the projection."""
    rows = labelled_readings(spark, sf_dir).select(F.array(*CHANNELS).alias("features"))
    fitted = components.fit_components(rows)
    cells = fitted.project(rows, 3).select(F.posexplode("components").alias("place", "x"))
    squares = cells.groupBy((F.col("place") + 1).alias("component")).agg(
        F.avg(F.col("x") * F.col("x")).alias("mean_square")
    )
    return fitted.table(spark).where("component <= 3").join(squares, "component").select(
        "component",
        F.round("variance", 3).alias("variance"),
        F.round("share", 9).alias("share"),
        F.round("mean_square", 3).alias("mean_square"),
    )
