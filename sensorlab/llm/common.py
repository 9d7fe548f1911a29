"""Helpers shared by the operators: written tables, Arrow batches, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlab.session import scratch_path

# The white space that separates words.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

U = np.uint64
# Multipliers of a widely used 64-bit mixing function.
MIX_A, MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
GOLDEN = U(0x9E3779B97F4A7C15)

#: Bytes of text that a task takes into numpy arrays at once, and rows that it takes as objects.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared scratch folder, removed when the application ends."""
    path = scratch_path(spark, tag)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the scratch folder and read it back.

    Lineage ends there, so a lost executor costs its tasks only.
    """
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of at most SLICE_ROWS rows, so that few texts are held as objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)
    pa.default_memory_pool().release_unused()


def map_arrow(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Apply a function of one Arrow batch to every small batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(function, small_batches(batches))

    return df.mapInArrow(run, schema)


def n_words(text) -> "F.Column":
    """Number of words as a JVM expression; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes; a longer text is a range by itself."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if texts:
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2^64; the longest table so far is kept."""
    if base not in _tables or len(_tables[base]) < n:
        out = np.full(max(n, SLICE_BYTES + 10_000), base, dtype=U)
        out[0] = 1
        _tables[base] = np.multiply.accumulate(out)
    return _tables[base][:n]


_BYTE = mix((np.arange(256, dtype=U) + U(1)) * GOLDEN)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[ord(c) for c in SPACE]] = True


def word_hashes(texts: list[bytes], head: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z lower-cased, and the number of words of every text.

    The hash of a word is a polynomial in its bytes, taken from running sums. With
    ``head`` the first so many bytes are hashed, of words that are longer.
    """
    joined = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    gap = _GAP[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    if head is not None:
        longer = stops - starts > head
        starts, stops = starts[longer], starts[longer] + head
    up = _powers(_BASE, len(joined) + 1)
    down = _powers(_INVERSE, len(joined) + 1)
    sums = np.zeros(len(joined) + 1, dtype=U)
    np.cumsum(_BYTE[_LOWER[joined]] * up[:-1], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U))
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    return hashes, counts
