"""Delimited text recordings as tables, and back.

All readers are ``spark.read`` scans with column expressions behind them, so
files stay splittable.  Readings are strict by default: a record with a short
or bad field fails the job whatever columns it uses.  ``lazy=True`` converts
the used columns only, and so notices the faults in those only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlab.functions.labels import SECONDS_PER_READING
from sensorlab.schema import CHANNELS, EXPLORATION_NAMES, LABEL
from sensorlab.session import remove_at_end, scratch_path


#: Name of the split record while it is converted.
FIELDS = "__fields"

#: Parts that rows are dealt to by partition value before Spark joins small ones and splits large ones.
DEALT = 64
#: Text files that a task of a partitioned write holds open at once.
OPEN_FILES, OPEN_FILES_KEY = 100, "spark.sql.maxConcurrentOutputFileWriters"


def to_number(text: Column, permissive: bool = False, name: str = "a cell") -> Column:
    """Text to double, blanks around it allowed.  What is no number gives null if
    permissive, else fails the job, whatever the session's ANSI setting."""
    number = text.try_cast("double")
    if permissive:
        return number
    problem = F.raise_error(F.lit(f"missing or not a number: {name}"))
    return F.coalesce(number, problem.cast("double"))


def parse_fields(
    lines: DataFrame,
    names: Sequence[str],
    separator: str = "\t",
    permissive: bool = False,
    line: str = "value",
    lazy: bool = False,
) -> DataFrame:
    """Replace a text column by one double column per name.

    Surplus fields are ignored; a missing one counts as no number.  Unless lazy
    or permissive, every record is checked as a whole: its fields are converted
    once, by a generator of one row, and the filter behind it reads all of them,
    so no query can leave it out and none is converted twice.
    """
    fields = F.split(F.col(line), separator)
    rest = [c for c in lines.columns if c != line]
    if lazy or permissive:
        parsed = [
            to_number(F.get(fields, F.lit(i)), permissive, name).alias(name)
            for i, name in enumerate(names)
        ]
        return lines.select(*rest, *parsed)
    parsed = _converted(lines.select(*rest, fields.alias(FIELDS)), names, rest)
    bad = reduce(or_, [F.col(f"`{name}`").isNull() for name in names])
    problem = F.raise_error(F.lit("a record is short or holds no number")).cast("boolean")
    return parsed.where(F.when(bad, problem).otherwise(F.lit(True)))


def _converted(split: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The first fields of every record as doubles, null for what is no number."""
    cells = [F.get(FIELDS, F.lit(i)).try_cast("double").alias(name) for i, name in enumerate(names)]
    return split.select(*keep, F.inline(F.array(F.struct(*cells))))


def read_readings(
    spark: SparkSession, path: str | list[str], permissive: bool = False, lazy: bool = False
) -> DataFrame:
    """Tab-separated readings from a file, several files or a folder."""
    return parse_fields(
        spark.read.text(path), CHANNELS + [LABEL], "\t", permissive, lazy=lazy
    )


def try_read_readings(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """The same, or None where the path cannot be read."""
    try:
        return read_readings(spark, path)
    except AnalysisException:
        return None


def read_readings_by_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Readings with the file each one came from."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), "value"
    )
    return parse_fields(lines, CHANNELS + [LABEL])


def read_whitespace(
    spark: SparkSession, path: str | list[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Headerless columns separated by runs of blanks, named on the way in."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    return parse_fields(lines, names or EXPLORATION_NAMES, r"\s+")


def read_csv_trimmed(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType = "name string, age int"
) -> DataFrame:
    """Comma-separated records with blanks around the fields."""
    return spark.read.csv(
        path,
        schema=schema,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        mode="FAILFAST",
    )


def list_source_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Paths of the files behind a folder, one row each."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path")).distinct()


def _scan_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with the file and split they are in and an id that follows their order."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("scan_id"),
        "value",
    )


def _number(scanned: DataFrame, target: str | None = None) -> DataFrame:
    """Replace split and id by the line's number in its file, counted from 1.

    A file may be far larger than a task can order.  Ids are consecutive inside
    a split, so a line's number is its distance from the split's first id plus
    the lines of the file's earlier splits.  Only the table of splits is
    windowed; how it is joined is left to Spark.

    The scan is written once, because how files are split can change from one
    scan to the next as a cluster grows or loses executors.  ``target`` is where:
    a caller that converts a recording names the table it wants to keep;
    otherwise it is scratch, removed when the application ends.
    """
    spark = scanned.sparkSession
    path = target or scratch_path(spark, "scanned")
    scanned.write.parquet(path)
    if target is None:
        remove_at_end(spark, path)
    rest = [c for c in scanned.columns if c not in ("file_path", "block_start", "scan_id")]
    return _numbered(spark.read.parquet(path)).select("file_path", "reading_no", *rest)


def _numbered(lines: DataFrame) -> DataFrame:
    """Add the number of every written line in its file; see :func:`_number`."""
    spark = lines.sparkSession
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        lines.groupBy("file_path", "block_start")
        .agg(F.min("scan_id").alias("first_id"), F.count("*").alias("lines"))
        .select(
            "file_path",
            "block_start",
            (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first_id") + 1).alias(
                "shift"
            ),
        )
    )
    splits = scratch_path(spark, "splits")
    offsets.write.parquet(splits)
    remove_at_end(spark, splits)
    offsets = spark.read.parquet(splits)
    rest = [c for c in lines.columns if c not in ("file_path", "block_start", "scan_id")]
    return lines.join(offsets, ["file_path", "block_start"]).select(
        "file_path", (F.col("scan_id") + F.col("shift")).alias("reading_no"), *rest
    )


def read_numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file and their number in it."""
    return _number(_scan_lines(spark, path))


def read_recording(
    spark: SparkSession, path: str | list[str], target: str | None = None
) -> DataFrame:
    """Readings with file, number in the file and seconds since its start.

    What is written on the way is the readings as columns: with ``target`` it is
    kept there as the one conversion from text that later scans profit from.
    """
    numbered = _number(parse_fields(_scan_lines(spark, path), CHANNELS + [LABEL]), target)
    return numbered.withColumn("seconds", (F.col("reading_no") - 1) * F.lit(SECONDS_PER_READING))


def write_delimited(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    separator: str = "\t",
    partition_by: str | None = None,
) -> str:
    """Write the columns as headerless text, a few files per partition value.

    A task appends its rows to one open file per value and so need not sort them.
    """
    line = F.concat_ws(separator, *[F.col(c).cast("string") for c in columns]).alias("value")
    keys = [partition_by] if partition_by else []
    with _open_files(df.sparkSession, OPEN_FILES if keys else None):
        _arranged(df.select(line, *keys), partition_by).write.mode("overwrite").partitionBy(
            *keys
        ).text(path)
    return path


@contextmanager
def _open_files(spark: SparkSession, count: int | None) -> Iterator[None]:
    """Let a task of a partitioned write hold so many files open; beyond them it sorts its rows."""
    before = spark.conf.get(OPEN_FILES_KEY, None)
    if count:
        spark.conf.set(OPEN_FILES_KEY, count)
    try:
        yield
    finally:
        if count:
            spark.conf.unset(OPEN_FILES_KEY) if before is None else spark.conf.set(OPEN_FILES_KEY, before)


def _arranged(df: DataFrame, key: str | None) -> DataFrame:
    """Rows of one key in few tasks: small keys share one, a hot one is split over several.

    Up to ``DEALT`` parts a map task writes its rows straight to them, without a buffer that spills.
    """
    return df.hint("rebalance", DEALT, key) if key else df


def to_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Convert once, so later scans prune columns and push filters down.

    Rows of one partition value are brought together before they are written, so
    there are a few files per value; a value holding a third of the table is
    split over several tasks.
    """
    writer = _arranged(df, partition_by).write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path


@dataclass
class Accounted:
    """A recording read with an account of its bad records, from one scan of the text.

    ``readings`` are the good records with file and line number, ``rejects`` the others
    (file_path, reading_no, reason, value), and ``counts`` lines, accepted, short and
    not a number, which the scan itself counted.
    """

    readings: DataFrame
    rejects: DataFrame
    counts: dict[str, int]

    def reconciled(self) -> bool:
        """Whether both tables together hold every line that was scanned."""
        return self.counts["lines"] == self.readings.count() + self.rejects.count()


def read_accounted(
    spark: SparkSession,
    path: str | list[str],
    names: Sequence[str] = (*CHANNELS, LABEL),
    separator: str = "\t",
    target: str | None = None,
) -> Accounted:
    """Read every record; those with a short or bad field go to a table of their own.

    The text is scanned once: the scan converts each record once, counts good and bad ones on its
    way (``DataFrame.observe``), and writes both kinds as columns, apart by a partition
    value. Line numbers are counted per split afterwards, on what was written.
    """
    lines = _scan_lines(spark, path)
    split = lines.withColumn(FIELDS, F.split("value", separator))
    keep = ["file_path", "block_start", "scan_id", "value", FIELDS]
    parsed = _converted(split, names, keep)
    short = F.size(FIELDS) < len(names)
    bad = reduce(or_, [F.col(f"`{name}`").isNull() for name in names])
    reason = F.when(short, "short").when(bad, "not a number")
    told = parsed.withColumn("reason", reason).withColumn("accepted", reason.isNull())
    told = told.withColumn("value", F.when(reason.isNotNull(), F.col("value"))).drop(FIELDS)
    seen = Observation()
    told = told.observe(
        seen,
        F.count(F.lit(1)).alias("lines"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(F.col("reason") == "short").alias("short"),
        F.count_if(F.col("reason") == "not a number").alias("not a number"),
    )
    place = target or scratch_path(spark, "accounted")
    told.write.partitionBy("accepted").parquet(place)
    if target is None:
        remove_at_end(spark, place)
    counts = {name: int(value) for name, value in seen.get.items()}
    # a folder without a partition has no accepted column to infer
    schema = T.StructType([f for f in told.schema.fields if f.name != "accepted"]).add("accepted", "boolean")
    held = spark.read.schema(schema).parquet(place)
    numbered = _numbered(held)
    readings = numbered.where("accepted").select("file_path", "reading_no", *[f"`{n}`" for n in names])
    rejects = numbered.where("NOT accepted").select("file_path", "reading_no", "reason", "value")
    return Accounted(readings, rejects, counts)
