"""Counting operators.  Each is one partial-then-final aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.schema import LABEL


def dimensions(df: DataFrame) -> DataFrame:
    """Row and column count of a table."""
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))


def count_by(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def range_label_counts(
    df: DataFrame, ranges: Sequence[tuple[int, int]], activity: str = LABEL
) -> DataFrame:
    """Per activity code, how many rows fall in each range; columns ``lo_hi``."""
    inside = [
        F.sum(F.col(activity).between(lo, hi).cast("bigint")).alias(f"{lo}_{hi}")
        for lo, hi in ranges
    ]
    return df.groupBy(activity).agg(*inside)


def range_label_totals(
    df: DataFrame, ranges: Sequence[tuple[int, int]], activity: str = LABEL
) -> DataFrame:
    """Totals of :func:`range_label_counts` over all codes."""
    counts = range_label_counts(df, ranges, activity)
    names = [f"{lo}_{hi}" for lo, hi in ranges]
    return counts.agg(*[F.sum(f"`{n}`").alias(n) for n in names])


def reconcile(df: DataFrame, source: str) -> DataFrame:
    """Rows per source, and of the whole in a row marked as the total.

    The rollup runs over the counted sources, so no row is expanded.
    """
    return count_by(df, source).rollup(source).agg(
        F.sum("count").alias("count"), (F.grouping(source) == 1).alias("is_total")
    )


def class_count(df: DataFrame, label: str = "binaryLabel") -> DataFrame:
    """Number of classes, 1 + the largest label; labels must be whole and not negative."""
    y = F.col(label)
    bad = F.max(((y < 0) | (y != F.floor(y)) | y.isNull()).cast("int"))
    return df.agg(
        F.when(bad == 1, F.raise_error(F.lit("labels must be whole numbers from 0")).cast("int"))
        .otherwise((F.max(y) + 1).cast("int"))
        .alias("classes")
    )


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each blank-separated word; empty words at the end of a
    text are dropped, those inside it are kept.  All-blank texts have no words."""
    df = df.where(~F.col(text).rlike("^ +$"))
    words = F.explode(F.split(F.rtrim(text), " ", -1))
    return df.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("count"))
