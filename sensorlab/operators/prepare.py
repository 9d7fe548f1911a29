"""Row-level operators: filters, labels, ids, scaling, slices, splits, unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlab.functions.hashing import HASH_RANGE, unit_hash
from sensorlab.functions.labels import binary_label, is_labelled, velocity
from sensorlab.schema import LABEL, append_column


def labelled(df: DataFrame, activity: str = LABEL) -> DataFrame:
    return df.where(is_labelled(activity))


def unlabelled(df: DataFrame, activity: str = LABEL) -> DataFrame:
    return df.where(F.col(activity) == 0)


def with_binary_label(
    df: DataFrame, activity: str = LABEL, name: str = "binaryLabel", dtype: str = "double"
) -> DataFrame:
    return append_column(df, name, binary_label(activity, dtype))


def with_unique_id(df: DataFrame, name: str = "uniqueID") -> DataFrame:
    """Unique 64-bit ids.  They increase but are not consecutive, and follow the
    partitioning; use a file and reading number where an id must be stable."""
    return append_column(df, name, F.monotonically_increasing_id())


def with_velocity(df: DataFrame, places: dict[str, Sequence[str]]) -> DataFrame:
    """Add one velocity column per place, from its three acceleration columns."""
    return df.withColumns({name: velocity(*axes) for name, axes in places.items()})


def _extremes(df: DataFrame, column: str) -> tuple[Column, Column]:
    """Minimum and maximum as scalar subqueries: one extra aggregate, no join."""
    return df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()


def minmax(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scale a column to [0, 1] by the table's extremes; null where they are equal."""
    low, high = _extremes(df, column)
    return df.withColumn(name, F.try_divide(F.col(column) - low, high - low))


def scale_symmetric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale each column to [-1, 1] in place."""
    scaled = {}
    for c in columns:
        low, high = _extremes(df, c)
        scaled[c] = F.try_divide(F.col(c) - low, high - low) * 2.0 - 1.0
    return df.withColumns(scaled)


def first_n(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """The first rows by a full sort key: a bounded top-n, not a full sort."""
    return df.orderBy(*order).limit(n)


def row_slice(df: DataFrame, first: int, last: int, position: str) -> DataFrame:
    """Rows whose position lies between two numbers, both included."""
    return df.where(F.col(position).between(first, last))


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables, duplicates kept, columns matched by name."""
    if not tables:
        raise ValueError("nothing to union")
    return reduce(DataFrame.unionByName, tables)


def union_by_position(tables: Sequence[DataFrame]) -> DataFrame:
    if not tables:
        raise ValueError("nothing to union")
    return reduce(DataFrame.union, tables)


def random_split(
    df: DataFrame, test_fraction: float, seed: int = 12345
) -> tuple[DataFrame, DataFrame]:
    """Spark's seeded random split.  It follows partitions and row order; use
    ``hash_split`` where the parts must survive a repartition or a re-read."""
    train, test = df.randomSplit([1.0 - test_fraction, test_fraction], seed=seed)
    return train, test


def in_test(key: Column, test_fraction: float, seed: int = 0) -> Column:
    """Whether a key falls in the test part; depends on the key alone."""
    return unit_hash(key, seed) < F.lit(int(test_fraction * HASH_RANGE))


def hash_split(
    df: DataFrame, key: str, test_fraction: float, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key: no shuffle, same parts wherever it runs."""
    test = in_test(F.col(key), test_fraction, seed)
    return df.where(~test), df.where(test)


def with_fold(
    df: DataFrame, key: str, folds: int, name: str = "fold", seed: int = 0
) -> DataFrame:
    """Add a fold number 0 .. folds-1 by a hash of the key.

    A part of a ``hash_split`` is a range of the single hash, so folds need an
    independent one: the hash, its upper half mixed into its lower, hashed again.
    """
    once = unit_hash(F.col(key), seed)
    mixed = unit_hash(once.bitwiseXOR(F.shiftright(once, 16)))
    number = F.floor(mixed * F.lit(folds) / F.lit(HASH_RANGE))
    return append_column(df, name, number.cast("int"))


def _bins(df: DataFrame, h: Column, low: int, width: int, step: int) -> list[tuple[int, int]]:
    """Rows per bin of the hash range; at most width / step bins reach the driver."""
    rows = df if width == HASH_RANGE else df.where((h >= F.lit(low)) & (h < F.lit(low + width)))
    number = F.floor((h - F.lit(low)) / F.lit(step)).alias("bin")
    return sorted((int(r["bin"]), r["count"]) for r in rows.groupBy(number).count().collect())


def _rank_cut(df: DataFrame, key: str, fraction: float, seed: int) -> tuple[int, int] | None:
    """Hash and key of the last chosen row by (hash, key); None where none is.

    The hash range is narrowed by counting 2^11 equal bins, three times, so
    that no rows are sorted or gathered.
    """
    h = unit_hash(F.col(key), seed)
    # a hot or coarse key shows here, before any of its rows are gathered
    size = df.agg(F.count("*").alias("n"), F.approx_count_distinct(key, 0.02).alias("keys")).first()
    if size["keys"] < 0.9 * size["n"]:
        raise ValueError(f"{key} is not unique; an exact split needs a unique key")
    low, width, wanted = 0, HASH_RANGE, None
    while width > 1:
        step = max(1, width // 2048)
        bins = _bins(df, h, low, width, step)
        if wanted is None:
            wanted = int(fraction * sum(count for _, count in bins))
            if wanted == 0:
                return None
        for number, count in bins:
            if count >= wanted:
                low, width = low + number * step, step
                break
            wanted -= count
    # rows sharing one hash value: about n / 2^32 of them when keys are unique
    ties = df.where(h == F.lit(low)).select(key)
    found = ties.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys")).first()
    if found["n"] != found["keys"]:
        raise ValueError(f"{key} is not unique; an exact split needs a unique key")
    edge = ties.orderBy(key).limit(wanted).agg(F.max(key)).first()[0]
    return low, edge


def exact_split(
    df: DataFrame, key: str, fraction: float, seed: int = 1234
) -> tuple[DataFrame, DataFrame]:
    """Exactly ``floor(fraction * n)`` rows without replacement, and the others.

    ``key`` must be a unique integer; a key
    that is plainly not, or repeats where the cut falls, is refused.  The parts are plain filters over the
    input: rows are neither sorted nor shuffled.
    """
    cut = _rank_cut(df, key, fraction, seed)
    if cut is None:
        return df.where(F.lit(False)), df
    cut_hash, cut_key = cut
    h = unit_hash(F.col(key), seed)
    chosen = (h < F.lit(cut_hash)) | ((h == F.lit(cut_hash)) & (F.col(key) <= F.lit(cut_key)))
    return df.where(chosen), df.where(~chosen)
