"""Named views, SQL text, the table list, and tables from local collections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def publish(df: DataFrame, name: str) -> str:
    """Register a view all sessions of the application can read; returns its full name."""
    df.createOrReplaceGlobalTempView(name)
    return f"global_temp.{name}"


def query(spark: SparkSession, text: str, new_session: bool = False, **args) -> DataFrame:
    """Run SQL text, with named parameters, here or in a new session of the application."""
    session = spark.newSession() if new_session else spark
    return session.sql(text, args=args or None)


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def from_local(
    spark: SparkSession, rows: Iterable[Sequence] | object, schema: str | T.StructType | None = None
) -> DataFrame:
    """A small local collection or pandas frame as a table."""
    return spark.createDataFrame(rows, schema=schema)
