"""Feature vectors: assembling, slicing, checking, principal components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlab.functions.arrow import matrix
from sensorlab.schema import check_feature_columns


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """Numeric columns as one vector column."""
    check_feature_columns(columns, df)
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def slice_by_name(
    df: DataFrame, names: Sequence[str], source: str = "features", target: str = "sliced"
) -> DataFrame:
    """Parts of an assembled vector, chosen by the names of its inputs."""
    return VectorSlicer(inputCol=source, outputCol=target, names=list(names)).transform(df)


def slice_by_index(
    df: DataFrame, indices: Sequence[int], source: str = "features", target: str = "sliced"
) -> DataFrame:
    return VectorSlicer(inputCol=source, outputCol=target, indices=list(indices)).transform(df)


def as_array(df: DataFrame, column: str) -> Column:
    """A vector or array column as ``array<double>``."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, VectorUDT):
        return vector_to_array(F.col(column))
    if isinstance(dtype, T.ArrayType):
        return F.col(column).cast("array<double>")
    raise ValueError(f"Column {column} must be a vector or an array, not {dtype.simpleString()}")


def as_vector(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(as_array(df, column)))


def feature_count(df: DataFrame, column: str = "features") -> DataFrame:
    """Length of the vectors, checked to be the same in every row."""
    size = F.size(as_array(df, column))
    return df.agg(F.min(size).alias("low"), F.max(size).alias("features")).select(
        F.when(
            F.col("low") != F.col("features"),
            F.raise_error(F.lit("vectors differ in length")).cast("int"),
        )
        .otherwise(F.col("features"))
        .alias("features")
    )


def cross_product(df: DataFrame, left: str, right: str) -> DataFrame:
    """Sum over rows of the outer product of two vector columns, as (i, j, value).

    Each task sends one small matrix; their sum is an ordinary aggregate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = matrix(batch.column("a")).T @ matrix(batch.column("b"))
                total = part if total is None else total + part
        if total is not None:
            height, width = total.shape
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(height, dtype=np.int32), width)),
                    pa.array(np.tile(np.arange(width, dtype=np.int32), height)),
                    pa.array(total.reshape(-1)),
                ],
                names=["i", "j", "value"],
            )

    pairs = df.select(as_array(df, left).alias("a"), as_array(df, right).alias("b"))
    parts = pairs.mapInArrow(run, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def covariance(df: DataFrame, source: str = "features") -> DataFrame:
    """Sample covariance of every pair of vector elements, as (i, j, cov) rows.

    Two scans: the mean vector, then products of the centred rows.
    """
    vector = as_vector(df.select(source), source, "vector")
    means, rows = vector.agg(
        vector_to_array(Summarizer.mean(F.col("vector"))).alias("mean"), F.count("*")
    ).first()
    if rows < 2:
        raise ValueError("covariance needs two rows")
    mean = F.array(*[F.lit(m) for m in means])
    centred = df.select(
        F.zip_with(as_array(df, source), mean, lambda x, m: x - m).alias("centred")
    )
    sums = cross_product(centred, "centred", "centred")
    return sums.select("i", "j", (F.col("value") / (rows - 1)).alias("cov"))


def fit_pca(df: DataFrame, k: int = 3, source: str = "features", target: str = "pca") -> PCAModel:
    """Leading principal components.  Rows are projected as they are, not centred."""
    return PCA(k=k, inputCol=source, outputCol=target).fit(df)
