"""Run registered queries against their SQL in DuckDB and compare all rows.

    python check_oracles.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter

import duckdb

from sensorlab.plans import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


# The same type in both engines.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        # a negative zero is another bit pattern, and must show as a difference
        return ("float", repr(value))
    return (type(value).__name__, repr(value))


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, function, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    df = function(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    count = sum(ours.values())
    if sql is None:
        return count > 0, f"{count} rows, no SQL"
    result = connection.sql(sql)
    names = result.columns
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    given = {n: TYPES.get(t, t) for n, t in df.dtypes}
    found = {n: str(t) for n, t in zip(names, result.types)}
    if given != found:
        odd = {n: (given[n], found[n]) for n in given if given[n] != found[n]}
        return False, f"types differ: {odd}"
    if ours != theirs:
        lost, extra = theirs - ours, ours - theirs
        return False, (
            f"{count} rows against {sum(theirs.values())}; SQL only: {list(lost)[:2]}; "
            f"query only: {list(extra)[:2]}"
        )
    return True, f"{count} rows equal"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    queries, oracles = all_queries()
    unknown = set(options.names) - set(queries)
    if unknown:
        parser.error(f"no such query: {sorted(unknown)}")
    spark, connection = session(), database(options.sf)
    failed = []
    for name in options.names or queries:
        start = time.perf_counter()
        try:
            ok, note = compare(
                spark, connection, queries[name], oracles.get(name), options.sf
            )
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {time.perf_counter() - start:6.2f}s {note}")
        sys.stdout.flush()
        failed += [] if ok else [name]
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
