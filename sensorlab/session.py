"""Where a job may keep written tables, taken from the session it is given."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Every executor must reach it.  A local-mode session that names none, as in
    tests, gets one of its own; any other must name it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_folders:
        folder = tempfile.mkdtemp(prefix="sensorlab-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_folders[app] = folder
    return _local_folders[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the scratch root; nothing exists there yet."""
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Remove what lies at the path when the application ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


@contextmanager
def kept(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Keep a table for the length of the block, then release it."""
    held = df.persist(level)
    try:
        yield held
    finally:
        held.unpersist()
