"""Importance resampling towards a target distribution, with counts by distinct line.

Features are runs of 1 to ``longest`` consecutive words, hashed to ``buckets``. Bucket
counts of a corpus are taken by segments: texts are cut at line feeds, equal lines
are grouped (partial counts come before the shuffle, so a line that a third of all rows
hold is one row of each task), the features of each distinct line are counted
once and multiplied by its occurrences, and n-grams that cross a line feed are added
from the texts. Words hold no line feed, so nothing else crosses.

A bucket's gain is its log ratio of target to corpus frequency, in thousandths; a
document's weight is the mean gain of its features, and its score adds Gumbel noise
that its id alone seeds. Gains are a table of ``buckets`` numbers, whatever the corpus, and
go to the tasks with the function; a task looks up each of a batch's distinct lines once.

Ranks are given without a global sort in one task: scores are whole numbers of a
bounded range, so their counts tell the score where the draw ends; rows from there on are
dealt by ranges, and counted on from range to range.

Null and empty texts and texts without words have no feature and weight 0. A null id is
hashed as an empty string. Repeated rows are scored apart and drawn apart; rows
with one score and one id are ranked in any order. An empty corpus gives an empty table,
and an empty target is a target without features. Columns of the table other than
id and text play no part.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlab.llm.common import small_batches, text_bytes, written

# A-Z lower-cased, and bytes that are no part of a word as spaces.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
#: Bytes of words that a task remembers with their buckets.
REMEMBERED_BYTES = 32_000_000

SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


class Hasher:
    """Buckets of features; those of short words are remembered up to a number of bytes."""

    def __init__(self, buckets: int):
        self.buckets, self.known, self.held = buckets, {}, 0

    def __call__(self, features: list[bytes]) -> np.ndarray:
        known, crc, buckets = self.known, zlib.crc32, self.buckets
        out = list(map(known.get, features))
        for i, found in enumerate(out):
            if found is None:
                feature = features[i]
                out[i] = crc(feature) % buckets
                if self.held < REMEMBERED_BYTES:
                    known[feature] = out[i]
                    self.held += 100 + len(feature)
        return np.array(out, np.int64)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def ngrams(words: list[bytes], longest: int) -> list[bytes]:
    out = list(words)
    for n in range(2, longest + 1):
        out += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out


def crossing(lines: list[list[bytes]], longest: int) -> list[bytes]:
    """N-grams with words of more than one line."""
    words = [w for line in lines for w in line]
    own = [i for i, line in enumerate(lines) for _ in line]
    return [
        b" ".join(words[i : i + n])
        for n in range(2, longest + 1)
        for i in range(len(words) - n + 1)
        if own[i] != own[i + n - 1]
    ]


def _counted(feature_lists: Callable, buckets: int) -> Callable:
    """A function of batches that leaves one row for each bucket with features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hasher = np.zeros(buckets, np.int64), Hasher(buckets)
        for batch in small_batches(batches):
            for features, times in feature_lists(batch):
                if features:
                    np.add.at(counts, hasher(features), times)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used])], names=["bucket", "n"]
        )

    return run


def bucket_counts(texts: DataFrame, buckets: int, longest: int = 1, text: str = "text") -> DataFrame:
    """(bucket, n) of all features of a column of texts."""

    def of_lines(batch: pa.RecordBatch):
        times = batch.column(1).to_pylist()
        return ((ngrams(words_of(t), longest), n) for t, n in zip(text_bytes(batch.column(0)), times))

    def of_borders(batch: pa.RecordBatch):
        for t in text_bytes(batch.column(0)):
            yield crossing([words_of(line) for line in t.split(b"\n")], longest), 1

    own = texts.select(F.col(text).alias("text"))
    lines = own.select(F.explode(F.split("text", "\n")).alias("line")).where("line != ''")
    lines = lines.groupBy("line").agg(F.count("*").alias("times"))
    counts = lines.mapInArrow(_counted(of_lines, buckets), "bucket long, n long")
    if longest > 1:
        counts = counts.unionByName(
            own.mapInArrow(_counted(of_borders, buckets), "bucket long, n long")
        )
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Gain of every bucket in thousandths; the two tables of counts have at most ``buckets`` rows."""

    def counts(df: DataFrame) -> list[int]:
        out = [0] * buckets
        for bucket, n in df.collect():
            out[bucket] = n
        return out

    s, t = counts(corpus), counts(target)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [
        math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t)))
        for a, b in zip(s, t)
    ]


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: list[int], longest: int, seed: int) -> DataFrame:
    """Columns of ``SCORED`` for every row."""
    table, buckets = np.array(gains, np.int64), len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)

        def gain(features: list[bytes]) -> int:
            return int(table[hasher(features)].sum()) if features else 0

        for batch in small_batches(batches):
            ids = batch.column(0).to_pylist()
            lines: dict[bytes, tuple[list[bytes], int, int, int]] = {}
            rows = []
            for doc_id, text in zip(ids, text_bytes(batch.column(1))):
                features = total = words = 0
                own = []
                for line in text.split(b"\n"):
                    known = lines.get(line)
                    if known is None:
                        found = words_of(line)
                        grams = ngrams(found, longest)
                        known = (found if longest > 1 else [], len(found), len(grams), gain(grams))
                        lines[line] = known
                    words += known[1]
                    features += known[2]
                    total += known[3]
                    own.append(known[0])
                if longest > 1:
                    across = crossing(own, longest)
                    features += len(across)
                    total += gain(across)
                weight = total // features if features else 0
                rows.append((doc_id, features, words, weight, weight + noise(seed, doc_id)))
            if rows:
                columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
                names = [part.split()[0] for part in SCORED.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.mapInArrow(run, SCORED)


def drawn(scored: DataFrame, least_words: int, per_cent: int) -> DataFrame:
    """Add ``rank``: 1, 2, ... for the highest scores among rows with enough words, null for others.

    The table is read several times and should be a written one.
    """
    able = F.col("n_words") >= least_words
    counts = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    # scores are thousandths of bounded logarithms: some ten thousand values at most
    by_score = sorted(((row["score"], row["n"]) for row in counts.collect()), reverse=True)
    wanted = per_cent * sum(n for _, n in by_score) // 100
    held, end = 0, None
    for score, n in by_score:
        if held >= wanted:
            break
        held, end = held + n, score
    if end is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    top = able & (F.col("score") >= end)
    placed = written(
        scored.where(top)
        .repartitionByRange(F.desc("score"), F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions(F.desc("score"), F.col("doc_id").asc_nulls_last())
        .withColumn("place", F.monotonically_increasing_id()),
        "placed",
    )
    # the upper 31 bits of a place are its range, the lower 33 its number there
    placed = placed.withColumn("range", F.shiftright("place", 33))
    # one row for each range: as many as the shuffle has partitions
    ranges = placed.groupBy("range").agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    placed = placed.join(F.broadcast(ranges), "range")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("rank", F.when(rank <= wanted, rank).cast("bigint"))
    ranked = ranked.drop("place", "range", "before")
    rest = scored.where(~F.coalesce(top, F.lit(False))).withColumn(
        "rank", F.lit(None).cast("bigint")
    )
    return ranked.unionByName(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = 10_000,
    longest: int = 1,
    seed: int = 2024,
    least_words: int = 20,
    per_cent: int = 10,
) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank of every document."""
    gains = bucket_gains(
        bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest), buckets
    )
    scored = written(scores(docs, gains, longest, seed), "scored")
    return drawn(scored, least_words, per_cent)
