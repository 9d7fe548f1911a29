import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlab import schema
from sensorlab.session import kept, scratch_path, scratch_root
from sensorlab.sources import catalog, text
from tests.conftest import reading_lines


def test_reading_schema_has_24_doubles():
    assert len(schema.READING) == 24
    assert {f.dataType for f in schema.READING} == {T.DoubleType()}
    assert len(set(schema.EXPLORATION_NAMES)) == 24
    plain = [n.replace("LAnkle", "Ankle").lower() for n in schema.EXPLORATION_NAMES]
    assert plain[:-1] == [c.lower() for c in schema.CHANNELS]
    assert schema.all_channels(schema.READING) == schema.CHANNELS


@pytest.mark.parametrize("bad", ["bla", "acc", "health"])
def test_unknown_feature_columns_are_rejected(bad):
    assert schema.check_feature_columns(schema.CHEST) == schema.CHEST
    with pytest.raises(ValueError, match=bad):
        schema.check_feature_columns([*schema.CHEST, bad])


def test_type_checks(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "i int, d double, s string")
    schema.require(df, {"d": "double", "i": ["bigint", "int"], "s": "text"})
    schema.require(df, {"i": "numeric", "d": "numeric"})
    wrong = {"s": "numeric", "i": "bigint", "d": "double", "z": "any"}
    assert schema.violations(df, wrong) == [
        ("s", "numeric", "string"), ("i", "bigint", "int"), ("z", "any", "absent")
    ]
    with pytest.raises(ValueError, match="s is string.*i is int.*z is absent.*ids"):
        schema.require(df, wrong, "ids")
    rows = schema.violation_table(df, wrong).collect()
    assert [(r["name"], r["filled"]) for r in rows] == [("s", 1), ("i", 1), ("z", 0)]
    assert schema.violation_table(df, {}).count() == 0
    with pytest.raises(ValueError, match="already"):
        schema.append_column(df, "d", F.lit(1))


def test_complete_rows_pass_and_nulls_fail(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert schema.require_complete(df.where("x is not null"), ["x"]).count() == 1
    with pytest.raises(PySparkException):
        schema.require_complete(df, ["x"]).collect()


def test_file_and_folder_hold_the_same_rows(spark, recording):
    files = [str(recording / f"subject{i}.txt") for i in (1, 2, 3)]
    one = text.read_readings(spark, files[0])
    assert one.columns == schema.CHANNELS + [schema.LABEL]
    rows = one.collect()
    assert len(rows) == 22
    assert rows[0]["acc_Chest_X"] == -9.5357
    assert rows[7]["acc_Chest_Y"] == -0.017569
    assert rows[17]["acc_Chest_Z"] == 0.92812
    parts = [text.read_readings(spark, f).count() for f in files]
    assert parts == [22, 30, 41]
    assert text.read_readings(spark, str(recording)).count() == sum(parts)
    by_file = text.read_readings_by_file(spark, str(recording)).groupBy("file_path").count()
    assert sorted(r["count"] for r in by_file.collect()) == parts
    names = sorted(r[0] for r in text.list_source_files(spark, str(recording)).collect())
    assert [n.rsplit("/", 1)[1] for n in names] == ["subject1.txt", "subject2.txt", "subject3.txt"]


def test_missing_path(spark, recording):
    assert text.try_read_readings(spark, str(recording / "none.txt")) is None
    assert text.try_read_readings(spark, str(recording)) is not None


@pytest.mark.parametrize(
    "name, line",
    [
        ("letters", "x\t" + "\t".join(["1.0"] * 23)),
        ("short", "\t".join(["1.0"] * 23)),
    ],
)
def test_bad_lines_fail_or_become_null(spark, tmp_path, name, line):
    path = tmp_path / f"{name}.txt"
    path.write_text("\n".join([*reading_lines(3, 1), line]) + "\n")
    for ansi in ("false", "true"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        with pytest.raises(PySparkException, match="holds no number"):
            text.read_readings(spark, str(path)).collect()
        with pytest.raises(PySparkException, match="not a number"):
            text.read_readings(spark, str(path), lazy=True).collect()
    unused = "acc_Chest_X" if name == "short" else "ecg_1"
    assert text.read_readings(spark, str(path), lazy=True).select(unused).count() == 4
    rows = text.read_readings(spark, str(path), permissive=True).collect()
    assert len(rows) == 4
    assert (rows[3]["acc_Chest_X"] is None) == (name == "letters")
    assert (rows[3]["activityLabel"] is None) == (name == "short")


def test_tolerated_lines(spark, tmp_path):
    base = ["0.5"] * 23
    lines = [
        "\t".join([*base, "1"]),
        "\t".join([*base, "1.0"]),
        "\t".join([*base, "1", "surplus"]),
        "\t".join([*base, "1"]) + "\t\t",
        "\t".join([*base, " 1 "]),
    ]
    path = tmp_path / "odd.txt"
    path.write_bytes(("\r\n".join(lines) + "\r\n").encode())
    rows = text.read_readings(spark, str(path)).collect()
    assert [r["activityLabel"] for r in rows] == [1.0] * 5
    empty = tmp_path / "empty.txt"
    empty.write_text("")
    assert text.read_readings(spark, str(empty)).count() == 0


def test_whitespace_table(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("  " + "   ".join(str(float(i)) for i in range(24)) + "\n")
    row = text.read_whitespace(spark, str(path)).first()
    assert row["Acc_Chest_X"] == 0.0 and row["Activity_Label"] == 23.0


def test_trimmed_csv(spark, tmp_path):
    path = tmp_path / "people.txt"
    path.write_text("Michael, 29\nAndy, 30\nJustin , 19\n")
    people = text.read_csv_trimmed(spark, str(path)).collect()
    assert people[1]["name"] == "Andy"
    assert sum(p["age"] > 21 for p in people) == 2
    with pytest.raises(IndexError):
        people[5]


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    for number, rows in ((1, 700), (2, 90)):
        lines = [f"{number}:{i}" for i in range(1, rows + 1)]
        (tmp_path / f"part{number}.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        numbered = text.read_numbered(spark, str(tmp_path))
        assert numbered.select("file_path").distinct().count() == 2
        rows = numbered.select("reading_no", "value").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 790
    assert all(int(r["value"].split(":")[1]) == r["reading_no"] for r in rows)


def test_recording_time(spark, recording):
    rows = text.read_recording(spark, str(recording / "subject1.txt")).orderBy("reading_no")
    assert [r["seconds"] for r in rows.limit(3).collect()] == [0.0, 0.02, 0.04]


def test_text_round_trip(spark, recording, tmp_path):
    rows = text.read_readings(spark, str(recording))
    path = text.write_delimited(rows, str(tmp_path / "out"), rows.columns)
    again = text.read_readings(spark, path)
    assert again.exceptAll(rows).count() == 0 and again.count() == rows.count()


def test_converted_table_prunes_and_pushes_down(spark, recording, tmp_path):
    rows = text.read_readings(spark, str(recording)).withColumn("subject", F.lit(1))
    path = text.to_parquet(rows, str(tmp_path / "columnar"), "subject")
    scan = spark.read.parquet(path).where("activityLabel > 0 and subject = 1").select("ecg_1")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(activityLabel,0.0)" in plan
    assert "ReadSchema: struct<ecg_1:double,activityLabel:double>" in plan
    assert "subject#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_views_are_seen_by_other_sessions(spark, recording):
    rows = text.read_readings(spark, str(recording / "subject1.txt")).coalesce(1)
    rows = rows.withColumn("uniqueID", F.monotonically_increasing_id())
    name = catalog.publish(rows, "one_subject")
    sql = f"SELECT acc_Chest_Y FROM {name} WHERE uniqueID = :id"
    here = catalog.query(spark, sql, id=3).first()[0]
    there = catalog.query(spark, sql, new_session=True, id=3).first()[0]
    assert here == there == rows.collect()[3]["acc_Chest_Y"]
    assert "one_subject" in catalog.list_tables(spark, "global_temp")


def test_local_collection(spark):
    df = catalog.from_local(spark, [("a", 1), ("b", 2)], "name string, n int")
    assert df.count() == 2


def test_scratch_and_scoped_cache(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "t") != scratch_path(spark, "t")
    df = spark.range(5)
    with kept(df) as held:
        assert held.is_cached
    assert not df.is_cached


def test_strict_reading_fails_whatever_is_used(spark, tmp_path):
    good, junk, short = reading_lines(3, 9, 1)
    cells = junk.split("\t")
    cells[10] = "junk"
    lines = [good, "\t".join(cells), "\t".join(short.split("\t")[:5])]
    for name, rows in (("one", lines), ("two", lines[:2]), ("three", [good, lines[2]])):
        path = tmp_path / f"{name}.txt"
        path.write_text("\n".join(rows) + "\n")
        for used in (lambda df: df.count(), lambda df: df.agg(F.sum("acc_Chest_X")).collect()):
            with pytest.raises(PySparkException):
                used(text.read_readings(spark, str(path)))
        assert text.read_readings(spark, str(path), lazy=True).count() == len(rows)
        assert text.read_readings(spark, str(path), permissive=True).count() == len(rows)
        with pytest.raises(PySparkException):
            text.read_recording(spark, str(path)).count()


def test_partitioned_writes_leave_few_files(spark, tmp_path):
    rows = spark.range(20_000, numPartitions=20).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 10).alias("subject"),
        F.col("id").cast("double").alias("x"),
    )
    text.to_parquet(rows, str(tmp_path / "p"), "subject")
    assert len(list((tmp_path / "p").rglob("*.parquet"))) <= 20
    assert spark.read.parquet(str(tmp_path / "p")).count() == 20_000
    text.write_delimited(rows, str(tmp_path / "t"), ["x"], partition_by="subject")
    assert len(list((tmp_path / "t").rglob("*.txt"))) <= 20


def test_a_hot_value_is_split_when_written(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(200_000, numPartitions=8).select(
            F.lit(1).alias("subject"), F.rand(1).alias("x")
        )
        text.to_parquet(rows, str(tmp_path / "hot"), "subject")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "hot").rglob("*.parquet"))) > 2


def test_a_partitioned_text_write_neither_buffers_nor_sorts(spark, tmp_path):
    parts, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    rows = spark.range(1_000).select((F.col("id") % 10).alias("subject"), F.col("id").cast("double").alias("x"))
    arranged = text._arranged

    def watched(df, key):
        dealt = arranged(df, key)
        seen.append(spark.conf.get(text.OPEN_FILES_KEY))
        seen.append(dealt._jdf.queryExecution().executedPlan().toString())
        return dealt

    spark.conf.set("spark.sql.shuffle.partitions", "400")
    text._arranged = watched
    try:
        text.write_delimited(rows, str(tmp_path / "t"), ["x"], partition_by="subject")
    finally:
        text._arranged = arranged
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    # over 200 parts a map task buffers what it deals out; without open files it sorts
    assert seen[0] == str(text.OPEN_FILES) and f", {text.DEALT})" in seen[1] and ", 400)" not in seen[1]
    assert spark.conf.get(text.OPEN_FILES_KEY) == "0"
    read = spark.read.text(str(tmp_path / "t")).select(F.col("value").cast("double").cast("long").alias("id"), "subject")
    assert read.where("id % 10 = subject").distinct().count() == 1_000
