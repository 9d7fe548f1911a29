"""Queries over whole penalty grids and over many scores at once.

The SQL solves every penalised problem on every fold by itself: Newton steps whose
quadratics are minimised by cyclic descent in a recursive query, absolute values included.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlab.operators import evaluate, features, linear, penalty_grid, prepare, tune
from sensorlab.plans import oracles as o
from sensorlab.plans.jobs import SPLIT_SEED, LogisticJobParams, run_logistic
from sensorlab.plans.registry import query
from sensorlab.schema import CHANNELS, LOGISTIC_FEATURES
from sensorlab.session import kept
from sensorlab.sources.adapters import labelled_readings, readings

NEWTON_STEPS, SWEEPS = 6, 40


def _descent(tag: str, source: str, n: int) -> str:
    """Minimise (h, g) of every problem about b by cyclic descent; weights u of table ``tag``."""
    j = f"(step % {n} + 1)"
    aim = f"(u[{j}] - res[{j}] / h[{j}][{j}])"
    new = f"(sign({aim}) * greatest(abs({aim}) - cut[{j}] / h[{j}][{j}], 0))"
    places = range(1, n + 1)
    moved = ", ".join(f"CASE WHEN {i} = {j} THEN fresh ELSE u[{i}] END" for i in places)
    left = ", ".join(f"res[{i}] + h[{i}][{j}] * (fresh - u[{j}])" for i in places)
    return (
        f"{tag}_steps AS (SELECT id, 0 AS step, b AS u, g AS res, h, cut FROM {source} UNION ALL "
        f"SELECT id, step + 1, [{moved}], [{left}], h, cut FROM (SELECT *, {new} AS fresh "
        f"FROM {tag}_steps WHERE step < {n * SWEEPS})), "
        f"{tag} AS (SELECT id, u FROM {tag}_steps WHERE step = {n * SWEEPS})"
    )


def _grid_parts(fold_seed: int = 0) -> list[str]:
    """Tables up to ``grid`` joined with ``metrics``: folds -1 (none left out) to the last."""
    names, folds = LOGISTIC_FEATURES, tune.LOGISTIC_FOLDS
    n = len(names) + 1
    fold = f"CAST(floor({o.knuth_twice('session_id', fold_seed)} * {folds} / 4294967296) AS INTEGER)"
    penalties = [(0.0, 0.0), *((r, e) for r in (0.01, 0.1) for e in (0.0, 0.5, 1.0))]
    x = ["1.0::DOUBLE", *(f"z{i}" for i in range(1, n))]
    z = " + ".join(f"w.b[{i + 1}] * {v}" for i, v in enumerate(x))
    scaled = ", ".join(
        f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z{i + 1}" for i, c in enumerate(names)
    )
    values = ", ".join(f"({r}::DOUBLE, {e}::DOUBLE)" for r, e in penalties)
    spread = ", ".join(f"stddev_samp(z{i})" for i in range(1, n))
    parts = [
        o.LABELLED,
        f"folded AS (SELECT binaryLabel AS y, {fold} AS fold, {scaled} FROM labelled)",
        f"out_folds AS (SELECT unnest(range(-1, {folds})) AS f)",
        f"spreads AS (SELECT f, [{spread}] AS r FROM folded JOIN out_folds ON fold <> f GROUP BY f)",
        "problems AS (SELECT row_number() OVER (ORDER BY f, strength, share) AS id, f, strength, share, "
        "list_concat([0.0::DOUBLE], [strength * share * v for v in r]) AS cut, "
        "list_concat([0.0::DOUBLE], [strength * (1 - share) * v * v for v in r]) AS ridge "
        f"FROM spreads, (VALUES {values}) AS t(strength, share))",
        f"w0 AS (SELECT id, f, cut, ridge, [{', '.join(['0.0::DOUBLE'] * n)}] AS b FROM problems)",
    ]
    for k in range(NEWTON_STEPS):
        sums = [
            f"sum(p * (1 - p) * {x[i]} * {x[j]}) / count(*) AS h{i}_{j}"
            for i in range(n)
            for j in range(i, n)
        ] + [f"sum((p - y) * {v}) / count(*) AS g{i}" for i, v in enumerate(x)]
        cells = ", ".join(
            "["
            + ", ".join(
                f"h{min(i, j)}_{max(i, j)}" + (f" + ridge[{i + 1}]" if i == j else "") for j in range(n)
            )
            + "]"
            for i in range(n)
        )
        slope = ", ".join(f"g{i} + ridge[{i + 1}] * b[{i + 1}]" for i in range(n))
        parts += [
            f"p{k} AS (SELECT w.id, folded.*, 1 / (1 + exp(-({z}))) AS p FROM folded JOIN w{k} w ON fold <> f)",
            f"s{k} AS (SELECT id, {', '.join(sums)} FROM p{k} GROUP BY id)",
            f"q{k} AS (SELECT id, b, cut, [{cells}] AS h, [{slope}] AS g FROM s{k} JOIN w{k} USING (id))",
            _descent(f"d{k}", f"q{k}", n),
            f"w{k + 1} AS (SELECT id, f, cut, ridge, u AS b FROM w{k} JOIN d{k} USING (id))",
        ]
    parts += [
        f"scored AS (SELECT w.id, y, {z} AS s FROM folded JOIN w{NEWTON_STEPS} w ON fold = f OR f = -1)",
        "mids AS (SELECT id, y, rank() OVER (PARTITION BY id ORDER BY s) "
        "+ (count(*) OVER (PARTITION BY id, s) - 1) / 2.0 AS mid FROM scored)",
        "areas AS (SELECT id, (sum(CASE WHEN y = 1 THEN mid ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) "
        "/ (sum(y) * sum(1 - y)) AS area FROM mids GROUP BY id)",
        "metrics AS (SELECT strength, share, avg(area) AS metric FROM areas JOIN problems USING (id) "
        "WHERE f >= 0 GROUP BY ALL)",
        "grid AS (SELECT CAST(row_number() OVER (ORDER BY reg_param, max_iter, elastic_net) - 1 AS INTEGER) "
        "AS point, * FROM (SELECT unnest([0.0::DOUBLE, 0.01, 0.1]) AS reg_param), "
        "(SELECT unnest([10, 50, 100]) AS max_iter), (SELECT unnest([0.0::DOUBLE, 0.5, 1.0]) AS elastic_net))",
    ]
    parts.append(
        "ranked AS (SELECT grid.*, metric, strength, share, "
        "CAST(row_number() OVER (ORDER BY round(metric, 6) DESC, point) AS INTEGER) AS rank FROM grid JOIN metrics "
        "ON strength = reg_param AND share = CASE WHEN reg_param = 0 THEN 0 ELSE elastic_net END)"
    )
    return parts


def _grid_sql() -> str:
    return (
        f"WITH RECURSIVE {', '.join(_grid_parts())} SELECT point, reg_param, elastic_net, "
        f"CAST(max_iter AS INTEGER) AS max_iter, {o.rounded('metric', 6)} AS metric, rank FROM ranked"
    )


def _tuned_sql() -> str:
    """The job's best point, and what its fit on all rows gives on them."""
    wrong = "avg(CASE WHEN (s > 0) <> (y > 0.5) THEN 1.0 ELSE 0.0 END)"
    parts = [
        *_grid_parts(SPLIT_SEED),
        "best AS (SELECT * FROM ranked WHERE rank = 1)",
        "chosen AS (SELECT id FROM problems JOIN best USING (strength, share) WHERE f = -1)",
    ]
    grid = ("reg_param", "elastic_net", "max_iter")
    rows = [f"SELECT 'best point' AS stage, '{c}' AS metric, {c}::DOUBLE AS value FROM best" for c in grid]
    rows += [
        f"SELECT 'tune', 'best auroc', {o.rounded('metric', 6)} FROM best",
        "SELECT 'tuned', 'rows', count(*)::DOUBLE FROM scored JOIN chosen USING (id)",
        f"SELECT 'tuned', 'misclassification', {o.rounded(wrong, 5)} FROM scored JOIN chosen USING (id)",
        f"SELECT 'tuned', 'auroc', {o.rounded('area', 5)} FROM areas JOIN chosen USING (id)",
        f"SELECT 'grid', 'point ' || point, {o.rounded('metric', 6)} FROM ranked",
        "SELECT 'rank', 'point ' || point, rank::DOUBLE FROM ranked",
    ]
    return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query("job_logistic_tuned", _tuned_sql())
def job_logistic_tuned(spark, sf_dir):
    """The tuned half of the logistic job: all averages, ranks, the best point and its model's figures."""
    result = run_logistic(
        spark,
        readings(spark, sf_dir),
        LogisticJobParams(key="session_id", model=linear.LogisticParams(tol=1e-12, maxIter=200)),
    )
    report = result.report.where(
        F.col("stage").isin("tune", "tuned") & ~F.col("metric").endswith("seconds")
    ).select(
        "stage",
        "metric",
        F.when(F.col("stage") == "tune", F.round("value", 6)).otherwise(F.round("value", 5)).alias("value"),
    )
    grid = result.grid
    best = grid.where("rank = 1").select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("best point").alias("stage"),
                        F.lit(c).alias("metric"),
                        F.col(c).cast("double").alias("value"),
                    )
                    for c in ("reg_param", "elastic_net", "max_iter")
                ]
            )
        )
    )
    name = F.concat(F.lit("point "), F.col("point"))
    points = grid.select(F.lit("grid").alias("stage"), name.alias("metric"), F.round("metric", 6).alias("value"))
    ranks = grid.select(F.lit("rank").alias("stage"), name.alias("metric"), F.col("rank").cast("double").alias("value"))
    return report.unionByName(best).unionByName(points).unionByName(ranks)


@query("logistic_grid_points", _grid_sql())
def logistic_grid_points(spark, sf_dir):
    """Every point of the job's penalty grid with its rank, five folds by key, in shared scans."""
    rows = features.assemble(
        labelled_readings(spark, sf_dir).select("binaryLabel", "session_id", *LOGISTIC_FEATURES),
        LOGISTIC_FEATURES,
    )
    rows = prepare.with_fold(rows, "session_id", tune.LOGISTIC_FOLDS)
    with kept(rows.select("features", "binaryLabel", "fold")) as held:
        table = penalty_grid.cross_validate_penalties(held, tune.logistic_points(), tune.LOGISTIC_FOLDS)
    return table.withColumn("metric", F.round("metric", 6))


_AREAS = " UNION ALL ".join(
    f"SELECT {i + 1}::BIGINT AS segment, round(area, 9) AS area, (SELECT count(*) FROM labelled) AS rows "
    f"FROM ({o.ranked_area('labelled', c, 'binaryLabel')})"
    for i, c in enumerate(CHANNELS)
)


@query("auroc_by_segment", f"WITH {o.LABELLED} {_AREAS}")
def auroc_by_segment(spark, sf_dir):
    """Area under the ROC curve of every channel as a score, in one ranking."""
    rows = labelled_readings(spark, sf_dir).select(
        "binaryLabel", F.posexplode(F.array(*CHANNELS)).alias("place", "score")
    )
    rows = rows.withColumn("segment", F.col("place") + 1)
    table = evaluate.area_under_roc_by(rows, "segment", "score")
    return table.select("segment", F.round("area", 9).alias("area"), "rows")


_CURVES = " UNION ALL ".join(
    f"SELECT '{c}' AS channel, {c} AS s, binaryLabel AS y FROM labelled" for c in ("acc_Chest_X", "ecg_1")
)


@query(
    "aupr_readings",
    f"WITH {o.LABELLED}, scores AS ({_CURVES}), points AS (SELECT channel, s, sum(y) AS p, "
    "count(*) AS c FROM scores GROUP BY ALL), curve AS (SELECT channel, s, "
    "sum(p) OVER (PARTITION BY channel ORDER BY s DESC) AS tp, "
    "sum(c) OVER (PARTITION BY channel ORDER BY s DESC) AS called, "
    "sum(p) OVER (PARTITION BY channel) AS all_p FROM points), "
    "xy AS (SELECT channel, s, tp / all_p AS recall, tp / called AS precision FROM curve), "
    "steps AS (SELECT channel, recall, precision, "
    "coalesce(lag(recall) OVER (PARTITION BY channel ORDER BY s DESC), 0.0) AS r0, "
    "coalesce(lag(precision) OVER (PARTITION BY channel ORDER BY s DESC), precision) AS p0 FROM xy) "
    "SELECT channel, round(sum((recall - r0) * (precision + p0) / 2), 9) AS area FROM steps GROUP BY channel",
)
def aupr_readings(spark, sf_dir):
    """Area under precision-recall of a score of fifty values and of one of nearly as many as rows."""
    rows = labelled_readings(spark, sf_dir)
    found = [(c, evaluate.area_under_pr(rows, c)) for c in ("acc_Chest_X", "ecg_1")]
    return spark.createDataFrame(found, "channel string, area double").select(
        "channel", F.round("area", 9).alias("area")
    )
