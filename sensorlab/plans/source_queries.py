"""Queries over text sources, views and local tables.

The text they read is written from the given tables at first use, whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlab.operators.aggregates import count_by, dimensions, reconcile
from sensorlab.plans import oracles as o
from sensorlab.plans.registry import query, written_once
from sensorlab.schema import CHANNELS, LABEL
from sensorlab.sources import catalog, text
from sensorlab.sources.adapters import readings, table, vectors

COLUMNS = CHANNELS + [LABEL]

# every field of a record
CHECKED = COLUMNS


def _sums(df, key):
    return df.groupBy(key).agg(
        F.count("*").alias("rows"), *[F.round(F.sum(c), 4).alias(c) for c in CHECKED]
    )


def _sums_sql(key: str) -> str:
    sums = ", ".join(f"{o.rounded(f'sum({c})', 4)} AS {c}" for c in CHECKED)
    return f"WITH {o.READINGS} SELECT {key}, count(*) AS rows, {sums} FROM readings GROUP BY {key}"


BY_LABEL = _sums_sql(LABEL).replace(f"SELECT {LABEL},", f"SELECT {LABEL} AS code,", 1)
BY_SUBJECT = _sums_sql("subject")


def _by_label(df):
    return _sums(df.withColumn("code", F.col(LABEL)), "code")


def _tab_folder(spark, sf_dir):
    return written_once(
        spark,
        sf_dir,
        "tabbed",
        lambda path: text.write_delimited(
            readings(spark, sf_dir), path, COLUMNS, partition_by="subject"
        ),
    )


def _flat_folder(spark, sf_dir, tag, separator):
    return written_once(
        spark,
        sf_dir,
        tag,
        lambda path: text.write_delimited(readings(spark, sf_dir), path, COLUMNS, separator),
    )


@query("scan_delimited", BY_LABEL)
def scan_delimited(spark, sf_dir):
    path = _flat_folder(spark, sf_dir, "flat", "\t")
    return _by_label(text.read_readings(spark, path))


@query(
    "scan_guarded",
    f"WITH {o.READINGS} SELECT count(*) AS rows, 25 AS columns, TRUE AS missing_is_none "
    "FROM readings",
)
def scan_guarded(spark, sf_dir):
    found = text.try_read_readings(spark, _tab_folder(spark, sf_dir))
    missing = text.try_read_readings(spark, f"{sf_dir}/no-such-recording.txt")
    return dimensions(found).withColumn("missing_is_none", F.lit(missing is None))


@query("scan_folder", BY_SUBJECT)
def scan_folder(spark, sf_dir):
    folder = text.read_readings(spark, _tab_folder(spark, sf_dir))
    return _sums(folder.withColumn("subject", F.col("subject").cast("bigint")), "subject")


def _subject_of(path: str):
    return F.regexp_extract(path, r"subject=(\d+)", 1).cast("bigint").alias("subject")


@query("scan_file_names", f"WITH {o.READINGS} SELECT DISTINCT subject FROM readings")
def scan_file_names(spark, sf_dir):
    files = text.list_source_files(spark, _tab_folder(spark, sf_dir))
    return files.select(_subject_of("file_path")).distinct()


@query(
    "reconcile_counts",
    f"WITH {o.READINGS} SELECT subject, count(*) AS count, FALSE AS is_total FROM readings "
    "GROUP BY subject UNION ALL SELECT NULL, count(*), TRUE FROM readings",
)
def reconcile_counts(spark, sf_dir):
    """Rows per file's subject and in all: the whole is the sum of its parts."""
    rows = text.read_readings_by_file(spark, _tab_folder(spark, sf_dir))
    return reconcile(rows.select(_subject_of("file_path")), "subject")


def _faulty_folder(spark, sf_dir):
    """Text of which some records are short and some hold a word."""

    def write(path: str) -> None:
        cells = [F.col(c).cast("string") for c in COLUMNS]
        odd = F.when(F.col("session_id") % 89 == 0, F.lit("n/a")).otherwise(cells[1])
        fields = F.array(cells[0], odd, *cells[2:])
        short = F.when(F.col("session_id") % 97 == 0, F.slice(fields, 1, 23)).otherwise(fields)
        readings(spark, sf_dir).select("subject", F.array_join(short, "\t").alias("value")).write.partitionBy(
            "subject"
        ).text(path)

    return written_once(spark, sf_dir, "faulty", write)


_FAULT = "CASE WHEN session_id % 97 = 0 THEN 'short' WHEN session_id % 89 = 0 THEN 'not a number' END"


@query(
    "scan_accounted",
    f"WITH {o.READINGS}, told AS (SELECT *, {_FAULT} AS reason FROM readings) "
    "SELECT 'readings' AS part, subject, '' AS reason, count(*) AS rows, "
    f"{o.rounded('sum(acc_Chest_X)', 4)} AS total FROM told WHERE reason IS NULL GROUP BY subject UNION ALL "
    "SELECT 'rejects', subject, reason, count(*), 0.0 FROM told WHERE reason IS NOT NULL GROUP BY subject, reason "
    "UNION ALL SELECT 'scan', NULL, 'lines', count(*), 0.0 FROM told UNION ALL SELECT 'scan', NULL, "
    "coalesce(reason, 'accepted'), count(*), 0.0 FROM told GROUP BY reason",
)
def scan_accounted(spark, sf_dir):
    """Good readings and rejects by subject, and the counts that the scan took on its way."""
    found = text.read_accounted(spark, _faulty_folder(spark, sf_dir))
    subject = _subject_of("file_path")
    good = found.readings.select(subject, "acc_Chest_X").groupBy("subject").agg(
        F.lit("readings").alias("part"),
        F.lit("").alias("reason"),
        F.count("*").alias("rows"),
        F.round(F.sum("acc_Chest_X"), 4).alias("total"),
    )
    bad = found.rejects.select(subject, "reason").groupBy("subject", "reason").agg(
        F.lit("rejects").alias("part"), F.count("*").alias("rows"), F.lit(0.0).alias("total")
    )
    counted = spark.createDataFrame(
        [("scan", None, name, n, 0.0) for name, n in found.counts.items() if n],
        "part string, subject long, reason string, rows long, total double",
    )
    return counted.unionByName(good).unionByName(bad)


@query(
    "scan_numbered",
    f"WITH {o.READINGS} SELECT count(*) AS rows, count(*) AS distinct_positions, "
    f"{o.rounded('sum(acc_Chest_X)', 4)} AS total FROM readings",
)
def scan_numbered(spark, sf_dir):
    """Readings numbered by file and line: no gap, no repeat in any file."""
    recording = text.read_recording(spark, _tab_folder(spark, sf_dir))
    per_file = recording.groupBy("file_path").agg(
        F.count("*").alias("rows"),
        F.max("reading_no").alias("last"),
        F.sum(F.col("reading_no").cast("decimal(38,0)")).alias("numbers"),
        F.sum("acc_Chest_X").alias("total"),
    )
    n = F.col("last").cast("decimal(38,0)")
    dense = (F.col("rows") == F.col("last")) & (F.col("numbers") * 2 == n * (n + 1))
    return per_file.agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(dense, F.col("last"))).alias("distinct_positions"),
        F.round(F.sum("total"), 4).alias("total"),
    )


@query("scan_whitespace", BY_LABEL)
def scan_whitespace(spark, sf_dir):
    path = _flat_folder(spark, sf_dir, "blanks", "  ")
    named = text.read_whitespace(spark, path).toDF(*COLUMNS)
    return _by_label(named)


@query(
    "scan_csv_trim",
    "SELECT c_name AS name, CAST(c_custkey % 80 AS INTEGER) AS age FROM customer",
)
def scan_csv_trim(spark, sf_dir):
    def write(path):
        people = table(spark, sf_dir, "customer").select(
            F.concat(F.lit("  "), "c_name", F.lit(" ,  "), F.expr("c_custkey % 80")).alias("value")
        )
        people.write.text(path)

    path = written_once(spark, sf_dir, "people", write)
    return text.read_csv_trimmed(spark, path)


@query(
    "filter_compare",
    "SELECT count(*) AS rows FROM customer WHERE c_custkey % 80 > 21",
)
def filter_compare(spark, sf_dir):
    return scan_csv_trim(spark, sf_dir).where(F.col("age") > 21).agg(F.count("*").alias("rows"))


@query(
    "cast_numeric",
    "SELECT l_linestatus AS status, round(sum(l_extendedprice), 2) AS total, "
    "CAST(sum(l_linenumber) AS BIGINT) AS codes, count(*) AS not_numbers "
    "FROM lineitem GROUP BY l_linestatus",
)
def cast_numeric(spark, sf_dir):
    """Numbers through text and back; text that is no number gives null if permissive."""
    cells = table(spark, sf_dir, "lineitem").select(
        "l_linestatus",
        F.col("l_extendedprice").cast("string").alias("price"),
        F.concat(F.lit(" "), F.col("l_linenumber").cast("string")).alias("code"),
    )
    bad = text.to_number(F.col("l_linestatus"), permissive=True).isNull()
    return cells.groupBy(F.col("l_linestatus").alias("status")).agg(
        F.round(F.sum(text.to_number(F.col("price"))), 2).alias("total"),
        F.sum(F.trim("code").cast("int")).alias("codes"),
        F.count_if(bad).alias("not_numbers"),
    )


@query(
    "parquet_by_subject",
    f"WITH {o.READINGS} SELECT subject, count(*) AS rows, "
    f"{o.rounded('sum(acc_Chest_X)', 4)} AS total FROM readings "
    f"WHERE subject <= 3 AND {LABEL} > 0 GROUP BY subject",
)
def parquet_by_subject(spark, sf_dir):
    """Convert once; then subjects prune folders and the label filter reaches the scan."""
    path = written_once(
        spark, sf_dir, "columnar",
        lambda p: text.to_parquet(readings(spark, sf_dir), p, "subject"),
    )
    rows = spark.read.parquet(path).where((F.col("subject") <= 3) & (F.col(LABEL) > 0))
    return rows.groupBy(F.col("subject").cast("bigint").alias("subject")).agg(
        F.count("*").alias("rows"), F.round(F.sum("acc_Chest_X"), 4).alias("total")
    )


@query(
    "from_local",
    f"WITH {o.READINGS} SELECT CASE WHEN {LABEL} = 0 THEN 'unlabelled' "
    f"WHEN {LABEL} <= 3 THEN 'inactive' ELSE 'active' END AS state, count(*) AS count "
    "FROM readings GROUP BY 1",
)
def from_local(spark, sf_dir):
    """Readings by the state that a local table of activity codes gives them."""
    states = ["unlabelled"] + ["inactive"] * 3 + ["active"] * 9
    codes = catalog.from_local(
        spark, [(float(i), s) for i, s in enumerate(states)], f"{LABEL} double, state string"
    )
    counts = count_by(readings(spark, sf_dir), LABEL)
    return counts.join(codes, LABEL).groupBy("state").agg(F.sum("count").alias("count"))


@query(
    "view_point_lookup",
    f"WITH {o.VECTORS} SELECT vec_id, embedding[2] AS y FROM vectors WHERE vec_id = 3",
)
def view_point_lookup(spark, sf_dir):
    name = catalog.publish(vectors(spark, sf_dir), "sensor_vectors")
    return catalog.query(
        spark,
        f"SELECT vec_id, embedding[1] AS y FROM {name} WHERE vec_id = :id",
        new_session=True,
        id=3,
    )
