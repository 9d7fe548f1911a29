"""The given tables in the shape of sensor readings and feature vectors.

``READING_SQL`` defines the mapping as SQL expressions.  They read the same in
any engine with 64-bit integers and doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlab.functions.labels import binary_label, is_labelled
from sensorlab.schema import ANKLE, ARM, CHANNELS, LABEL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reading_sql() -> dict[str, str]:
    sql = {
        "acc_Chest_X": "l_quantity",
        "acc_Chest_Y": "100 * l_discount",
        "acc_Chest_Z": "100 * l_tax",
        "ecg_1": "l_extendedprice",
        "ecg_2": "l_extendedprice * l_discount",
    }
    # further channels: residues of the keys by distinct primes
    primes = [97, 89, 83, 79, 73, 71, 67, 61, 59, 53, 47, 43, 41, 37, 31, 29, 23, 19]
    keys = ["l_partkey", "l_orderkey", "(l_partkey + l_orderkey)"]
    for i, (name, prime) in enumerate(zip(ANKLE + ARM, primes)):
        sql[name] = f"{keys[i % 3]} % {prime}"
    sql[LABEL] = "l_linenumber - 1"
    return {name: f"CAST({e} AS DOUBLE)" for name, e in sql.items()}


READING_SQL = _reading_sql()
SUBJECT_SQL = "l_suppkey % 10 + 1"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, session, 23 channels and activity code 0 to 6, from ``lineitem``."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr(SUBJECT_SQL).alias("subject"),
        F.col("l_orderkey").alias("session_id"),
        *[F.expr(READING_SQL[c]).alias(c) for c in CHANNELS + [LABEL]],
    )


def labelled_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with a code above 0, and their binary label."""
    rows = readings(spark, sf_dir).where(is_labelled())
    return rows.withColumn("binaryLabel", binary_label())


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-value vectors with a unique ``vec_id``, from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("double").alias(LABEL),
    )


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).where(is_labelled())
    return rows.withColumn("binaryLabel", binary_label())
