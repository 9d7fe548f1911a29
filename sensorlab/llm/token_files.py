"""Token ids in directly addressable codes, written to files and read back.

A segment holds the ids of some documents. Ids are split into chunks of eight
bits, lowest first. Level 0 has a chunk of every id; a level's bitmap tells which
of its ids go on, and those have a chunk in the next level. The place of an id in
the next level is the number of ones before it in the bitmap, which the rank
directory gives for every 512 bits; the rest is a count within one block. Any id
is so found by a few reads, and no block is decoded.

Segment bytes, little-endian: magic ``DAC1``; uint32 levels, documents; uint64
ids; uint64 first place of every document and the number of ids at the end; then
for each level its uint64 size, its chunks, and, but for the last level, its
bitmap (uint64 words) and its rank directory (uint64 for every 8 words).

Files are Parquet files of segments: range-partitioned by document id, so that a
failed task's output is discarded by Spark's committer and files can lie in any
store Spark writes to. Columns: part, segment, n_tokens, doc_ids, payload.

Null texts are empty and get the end id alone; null document ids come first;
documents with the same id follow each other by text. An empty table gives no
segment. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorlab.llm.tokens import encoder

MAGIC = b"DAC1"
CHUNK_BITS, BLOCK_WORDS = 8, 8
#: Ids after which a segment ends; a longer document ends the segment it is in.
SEGMENT_IDS = 1_000_000
#: Texts that are encoded at once.
TEXTS = 200

SCHEMA = "part int, segment int, n_tokens long, doc_ids array<bigint>, payload binary"


def pack(ids: np.ndarray, firsts: np.ndarray) -> bytes:
    """A segment of ids; ``firsts`` are the documents' first places and, last, len(ids)."""
    levels = []
    left = ids.astype(np.uint32)
    while True:
        chunk = (left & 255).astype(np.uint8)
        left = left >> CHUNK_BITS
        more = left > 0
        if not more.any():
            levels.append((chunk, None))
            break
        levels.append((chunk, more))
        left = left[more]
    out = [
        MAGIC,
        np.array([len(levels), len(firsts) - 1], "<u4").tobytes(),
        np.array([len(ids)], "<u8").tobytes(),
        firsts.astype("<u8").tobytes(),
    ]
    for chunk, more in levels:
        out += [np.array([len(chunk)], "<u8").tobytes(), chunk.tobytes()]
        if more is not None:
            bits = np.packbits(more, bitorder="little")
            words = np.zeros(-(-len(bits) // 64) * 64, np.uint8)
            words[: len(bits)] = bits
            blocks = np.bitwise_count(words.view("<u8")).reshape(-1, BLOCK_WORDS).sum(axis=1)
            ranks = np.concatenate(([0], np.cumsum(blocks)[:-1])).astype("<u8")
            out += [words.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Segment:
    """Reads a segment's bytes in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        levels, documents = np.frombuffer(payload, "<u4", 2, 4).tolist()
        self.n = int(np.frombuffer(payload, "<u8", 1, 12)[0])
        self.firsts = np.frombuffer(payload, "<u8", documents + 1, 20).astype(np.int64)
        at = 20 + 8 * (documents + 1)
        self.levels = []
        for level in range(levels):
            size = int(np.frombuffer(payload, "<u8", 1, at)[0])
            chunk = np.frombuffer(payload, np.uint8, size, at + 8)
            at += 8 + size
            if level == levels - 1:
                self.levels.append((chunk, None, None))
                break
            blocks = -(-size // (64 * BLOCK_WORDS))
            words = np.frombuffer(payload, "<u8", blocks * BLOCK_WORDS, at)
            at += 8 * len(words)
            ranks = np.frombuffer(payload, "<u8", blocks, at)
            at += 8 * blocks
            self.levels.append((chunk, words, ranks))

    def __getitem__(self, place: int) -> int:
        """One id, by one chunk and one rank for each level it reaches."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = shift = 0
        for chunk, words, ranks in self.levels:
            value |= int(chunk[place]) << shift
            shift += CHUNK_BITS
            if words is None:
                break
            word, bit = divmod(place, 64)
            bits = int(words[word])
            if not bits >> bit & 1:
                break
            block = word // BLOCK_WORDS
            before = words[block * BLOCK_WORDS : word]
            place = (
                int(ranks[block])
                + int(np.bitwise_count(before).sum())
                + (bits & ((1 << bit) - 1)).bit_count()
            )
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        total = np.zeros(self.n, np.uint32)
        live = np.arange(self.n)
        for level, (chunk, words, _) in enumerate(self.levels):
            total[live] |= chunk.astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            if words is None:
                break
            bits = np.unpackbits(words.view(np.uint8), count=len(chunk), bitorder="little")
            live = live[bits.view(bool)]
        return total


def _encode(vocabulary: str, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        part = TaskContext.get().partitionId()
        names: list[int | None] = []
        data: list[bytes] = []
        held = segment = 0

        def flush() -> pa.RecordBatch:
            firsts = np.cumsum([0, *(len(x) // 4 for x in data)])
            payload = pack(np.frombuffer(b"".join(data), "<u4"), firsts)
            columns = [
                pa.array([part], pa.int32()),
                pa.array([segment], pa.int32()),
                pa.array([held], pa.int64()),
                pa.array([names], pa.list_(pa.int64())),
                pa.array([payload], pa.binary()),
            ]
            fields = ["part", "segment", "n_tokens", "doc_ids", "payload"]
            return pa.RecordBatch.from_arrays(columns, names=fields)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a in range(0, batch.num_rows, TEXTS):
                texts = batch.column(1).slice(a, TEXTS).to_pylist()
                ids = encode([t or "" for t in texts])
                for name, x in zip(doc_ids[a : a + TEXTS], ids):
                    names.append(name)
                    data.append(x + tail)
                    held += len(x) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
                        names, data, held, segment = [], [], 0, segment + 1
        if names:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end: int, *, doc_id: str = "doc_id"
) -> None:
    """Encode texts in ascending order of document id and write segments to ``path``."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), "text")
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode(vocabulary, end), SCHEMA).write.parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, segment and ``start``, the number of ids in all segments before."""
    heads = spark.read.schema(SCHEMA).parquet(path).select("part", "segment", "n_tokens")
    before = (Window.unboundedPreceding, -1)
    parts = (
        heads.groupBy("part")
        .agg(F.sum("n_tokens").alias("size"))
        .select("part", F.sum("size").over(Window.orderBy("part").rowsBetween(*before)).alias("p"))
    )
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(*before)
    start = F.coalesce(F.col("p"), F.lit(0)) + F.coalesce(F.col("s"), F.lit(0))
    return (
        heads.withColumn("s", F.sum("n_tokens").over(inside))
        .join(parts, "part")
        .select("part", "segment", start.alias("start"))
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, number = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            names = batch.column(2)[row].values
            segment = Segment(batch.column(3)[row].as_py())
            data = memoryview(segment.ids().astype("<u4", copy=False).tobytes())
            firsts = segment.firsts.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(names), pa.int32()),
                    pa.array([number] * len(names), pa.int32()),
                    names,
                    pa.array(firsts[:-1], pa.int64()),
                    pa.array(np.diff(segment.firsts)),
                    pa.array(
                        [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(firsts, firsts[1:])],
                        pa.int64(),
                    ),
                ],
                names=["part", "segment", "doc_id", "place", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: its place, its number of ids and their crc32."""
    found = (
        spark.read.schema(SCHEMA)
        .parquet(path)
        .select("part", "segment", "doc_ids", "payload")
        .mapInArrow(
            _digests,
            "part int, segment int, doc_id long, place long, n_tokens long, ids_crc32 long",
        )
    )
    return found.join(segment_starts(spark, path), ["part", "segment"]).select(
        "doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )
