import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from sensorlab.schema import CHANNELS, LABEL  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("sensorlab-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.sql.debug.maxToStringFields", "200")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def reading_lines(rows: int, seed: int, active_from: int = 0) -> list[str]:
    """Tab-separated readings; labels cycle through 0 .. 12."""
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(rows, len(CHANNELS))).round(5)
    return [
        "\t".join([*(repr(float(v)) for v in row), str((active_from + i) % 13)])
        for i, row in enumerate(values)
    ]


@pytest.fixture(scope="session")
def recording(tmp_path_factory):
    """Three files of 22, 30 and 41 readings; three cells of the first are fixed."""
    folder = tmp_path_factory.mktemp("recording")
    for number, rows in enumerate([22, 30, 41], start=1):
        lines = reading_lines(rows, number, 1)
        if number == 1:
            for line, column, value in ((0, 0, "-9.5357"), (7, 1, "-0.017569"), (17, 2, "0.92812")):
                cells = lines[line].split("\t")
                cells[column] = value
                lines[line] = "\t".join(cells)
        (folder / f"subject{number}.txt").write_text("\n".join(lines) + "\n")
    return folder


@pytest.fixture(scope="session")
def signal(spark):
    """2,000 readings whose label follows the chest channels, with a unique key."""
    rng = np.random.default_rng(7)
    n = 2000
    x = rng.normal(size=(n, len(CHANNELS)))
    drive = np.sin(2 * x[:, 0]) + 0.7 * x[:, 1] - 0.4 * x[:, 2] ** 2
    code = np.where(drive > 0, rng.integers(4, 13, n), rng.integers(1, 4, n)).astype(float)
    code[rng.random(n) < 0.1] = 0.0
    rows = [(i, *map(float, x[i]), float(code[i])) for i in range(n)]
    schema = "key long, " + ", ".join(f"{c} double" for c in [*CHANNELS, LABEL])
    df = spark.createDataFrame(rows, schema).repartition(4, "key").persist()
    df.count()
    return df
