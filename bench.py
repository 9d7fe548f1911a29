"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder of the tables   (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads          (default 8)

Every query runs once to warm up, then ``REPEATS`` times; the fastest counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sensorlab.operators import evaluate, features, linear, prepare, tune
from sensorlab.operators.aggregates import count_by, range_label_counts
from sensorlab.operators.elm.layer import draw_layer
from sensorlab.operators.elm.model import ElmClassifier
from sensorlab.operators.tune import elm_grid_points
from sensorlab.plans import all_queries
from sensorlab.plans.jobs import ONLINE_NODES, VELOCITIES
from sensorlab.plans.registry import written_once
from sensorlab.schema import CHANNELS, CHEST, GLM_FEATURES, LABEL, LOGISTIC_FEATURES
from sensorlab.session import kept, scratch_path
from sensorlab.sources.adapters import labelled_readings, readings, table
from sensorlab.sources.text import read_readings
from sensorlab.streaming.online import OnlineElm

REPEATS = 2
SCALE = 50.0


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sensorlab-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)

    # The recording as a job meets it: converted once to parquet, in parts.
    def convert(path):
        readings(spark, sf_dir).repartition(int(cpus)).write.parquet(path)

    columnar = written_once(spark, sf_dir, "bench-readings", convert)
    source = spark.read.parquet(columnar)
    rows = prepare.with_binary_label(prepare.labelled(source))

    def inputs(columns, *keep):
        return rows.select(
            F.array(*[F.col(c) / SCALE for c in columns]).alias("features"), "binaryLabel", *keep
        )

    chest = inputs(CHEST)
    half, _ = prepare.hash_split(inputs(CHEST, "session_id"), "session_id", 0.5)

    def fit(frame, activation, nodes):
        return lambda: ElmClassifier(activationFunc=activation, hiddenNodes=nodes).fit(frame)

    model = fit(chest, "tanh", 100)()
    predictions = model.transform(chest)

    # what the online networks read: channels of all rows, velocities of a half, plain and scaled
    speeds = prepare.with_velocity(rows, VELOCITIES).select("session_id", "binaryLabel", *VELOCITIES)
    part, _ = prepare.hash_split(speeds, "session_id", 0.5)
    streams = {
        "channels": chest,
        "velocity_half": part.select(F.array(*VELOCITIES).alias("features"), "binaryLabel"),
        "scaled_half": prepare.scale_symmetric(part, list(VELOCITIES)).select(
            F.array(*VELOCITIES).alias("features"), "binaryLabel"
        ),
    }
    folders = {
        name: written_once(
            spark, sf_dir, f"bench-{name}", lambda path, t=t: t.repartition(int(cpus)).write.parquet(path)
        )
        for name, t in streams.items()
    }

    def online(name, nodes):
        def run():
            state = OnlineElm(spark, draw_layer(nodes, 3, "sigmoid"), scratch_path(spark, "state"))
            stream = (
                spark.readStream.schema("features array<double>, binaryLabel double")
                .option("maxFilesPerTrigger", 4)
                .parquet(folders[name])
            )
            state.start(stream, scratch_path(spark, "checkpoint")).awaitTermination()
            state.model()

        return run

    def ten_subjects():
        """As the published figure: the table of ten subjects' files, built but not run."""
        prepare.labelled(read_readings(spark, subject_files))

    def count_ten_subjects():
        prepare.labelled(read_readings(spark, subject_files)).count()

    def grid():
        folded = prepare.with_fold(inputs(CHEST, "session_id"), "session_id", tune.ELM_FOLDS)
        tune.elm_cross_validate(folded, elm_grid_points()).collect()

    def sweep():
        scored = rows.select(
            "binaryLabel", ((F.col("acc_Chest_X") - 1) / 49).alias("score")
        )
        evaluate.threshold_sweep(scored, "score", "binaryLabel").collect()

    def assembled(columns):
        return features.assemble(rows.select("binaryLabel", *columns), columns)

    def logistic():
        with kept(assembled(LOGISTIC_FEATURES)) as frame:
            linear.fit_logistic(frame)

    def binomial():
        with kept(assembled(GLM_FEATURES)) as frame:
            linear.fit_binomial(frame)

    folder_scan = all_queries()[0]["scan_folder"]
    folder_scan(spark, sf_dir)
    tabbed = written_once(spark, sf_dir, "tabbed", lambda path: None)
    subject_files = [f"{tabbed}/subject={i}" for i in range(1, 11)]
    work = {
        "ten_subject_files_build": ten_subjects,
        "ten_subject_files_count": count_ten_subjects,
        "scan_text_folder": lambda: folder_scan(spark, sf_dir).collect(),
        "count_by_activity": lambda: count_by(source, LABEL).collect(),
        "range_label_counts": lambda: range_label_counts(source, [(1, 3), (4, 12)]).collect(),
        "word_count": lambda: force(all_queries()[0]["word_count"](spark, sf_dir)),
        "threshold_sweep": sweep,
        "elm_fit_tanh_100": fit(chest, "tanh", 100),
        "elm_fit_sigmoid_50": fit(chest, "sigmoid", 50),
        "elm_fit_sigmoid_50_half": fit(half, "sigmoid", 50),
        "elm_fit_radbas_50_half": fit(half, "radbas", 50),
        "elm_online_sigmoid_10": online("channels", 10),
        "elm_online_sigmoid_40": online("channels", 40),
        **{
            f"elm_online_{name}_{nodes}": online(name, nodes)
            for name in ("velocity_half", "scaled_half")
            for nodes in ONLINE_NODES
        },
        "elm_score_tanh_100": lambda: force(predictions.select("rawPrediction", "prediction")),
        "misclassification": lambda: evaluate.error_metrics(predictions).collect(),
        "auroc": lambda: evaluate.area_under(predictions),
        "elm_grid_6_points_3_folds": grid,
        "pca_fit_23_channels": lambda: features.fit_pca(assembled(CHANNELS), 3),
        "logistic_fit": logistic,
        "binomial_fit": binomial,
    }
    chosen = sys.argv[1:] or list(work)
    seconds = {}
    for name in chosen:
        work[name]()
        times = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            work[name]()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)

    labelled_rows = labelled_readings(spark, sf_dir).count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "labelled_rows": labelled_rows,
                "documents": table(spark, sf_dir, "documents").count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
