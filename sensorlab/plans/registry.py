"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorlab.session import remove_at_end, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_written: dict[tuple[str, str, str], str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def written_once(
    spark: SparkSession, sf_dir: str, tag: str, write: Callable[[str], object]
) -> str:
    """Path of a derived copy of the tables, written at its first use by the application
    and removed when it ends.  The tables are taken not to change meanwhile."""
    key = (spark.sparkContext.applicationId, sf_dir, tag)
    if key not in _written:
        path = scratch_path(spark, tag)
        write(path)
        remove_at_end(spark, path)
        _written[key] = path
    return _written[key]
