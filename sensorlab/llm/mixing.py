"""Mixing sources to target weights.

Each source's words are packed, document after document, into blocks of ``BLOCK``
words. The mix is a table of slots, each filled by one block. Slots come in
output shards; how many slots of a shard each source gets is a multinomial draw
given the sources' totals, so every source ends at its target. A shard is found
by halving: a seeded draw splits the slots of a range of shards between its
halves, down to the shard. So each shard's draw, and the number of each source's
slots before it, is worked out by itself, and nothing is gathered.

A source's j-th slot takes the block at place j of a pseudorandom permutation
of its block numbers; where slots outnumber blocks, a further pass has a
permutation of its own. The last slot takes only the words the target still asks
for. Blocks are then joined with documents by source and block number.

Sources are ordered by code point, null last, and weigh 3, 1, 2, repeating.
Together they are to give 150 % of all words; a source stops at twice its words,
and what it cannot give is shared by weight among the others.

Null and empty texts have no words and take none. Repeated rows are documents of
their own. A table without words gives targets of 0. Columns that clash with a
result column are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorlab.llm.common import WORD, U, map_arrow, mix, n_words, written

#: Words of a block, slots of an output shard, documents of a bucket of the layout.
BLOCK, SHARD, BUCKET = 64, 16_384, 20_000
#: Slots up to which numpy's draw is used; it knows no more than 10^9.
NUMPY_SLOTS = 2**29
SEED = 17
# Weights of the sources in turn, and the shares of the targets.
WEIGHTS, TOTAL_SHARE, MOST = (3, 1, 2), 1.5, 2.0


def water_fill(sizes: list[int], weights: list[float], total: float) -> list[float]:
    """Targets in proportion to the weights, none above ``MOST`` times its size.

    What a full source cannot take is shared by weight until none is above.
    """
    targets = [0.0] * len(sizes)
    open_ = [i for i, size in enumerate(sizes) if size]
    left = float(total)
    while open_:
        share = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / share > MOST * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / share
            break
        for i in full:
            targets[i] = MOST * sizes[i]
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return targets


def _seed(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence((SEED, *key))))


def _even_split(counts: np.ndarray, half: int) -> np.ndarray:
    """Counts of a half in proportion to the whole; what is left over by largest remainder."""
    total = int(counts.sum())
    exact = [divmod(int(c) * half, total) for c in counts]
    first = np.array([q for q, _ in exact], np.int64)
    order = sorted(range(len(counts)), key=lambda i: (-exact[i][1], i))
    first[order[: half - int(first.sum())]] += 1
    return first


def _log_gamma_step(a: float, d: float) -> float:
    """log gamma(a + d) - log gamma(a), without the loss of taking large values apart."""
    if min(a, a + d) < 1e5:
        return math.lgamma(a + d) - math.lgamma(a)
    tail = (1 / (a + d) - 1 / a) / 12
    return (a - 0.5) * math.log1p(d / a) + d * math.log(a + d) - d + tail


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among ``drawn`` of ``good + bad``, for numbers of any size.

    Ratio of uniforms (Stadlober 1990): a point under the square root of the distribution,
    scaled to its mode, gives a value with the right chance.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    share = good / total
    spread = math.sqrt(drawn * share * (1 - share) * (total - drawn) / (total - 1) + 0.5)
    # 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e), the width of the hat
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    offset = float(drawn) * good / total - mode + 0.5
    places = (mode + 1, good - mode + 1, drawn - mode + 1, bad - drawn + mode + 1)
    while True:
        u, v = 1 - rng.random(), rng.random()
        step = math.floor(offset + width * (v - 0.5) / u)
        if low <= mode + step <= high:
            ratio = sum(
                _log_gamma_step(float(a), float(d)) for a, d in zip(places, (step, -step, -step, step))
            )
            if 2 * math.log(u) <= -ratio:
                return mode + step


def _large_draw(rng: np.random.Generator, counts: np.ndarray, drawn: int) -> np.ndarray:
    """What a draw without replacement takes of every source, one source after another."""
    rest, out = int(counts.sum()), []
    for count in counts.tolist():
        rest -= count
        out.append(hypergeometric(rng, count, rest, drawn))
        drawn -= out[-1]
    return np.array(out, np.int64)


def shard_draw(totals: np.ndarray, shard: int, shards: int, size: int) -> tuple:
    """Slots of each source in a shard, and in all shards before it.

    ``totals`` are the sources' slots in all shards of ``size`` slots; the last
    shard has the rest.
    """
    counts, before = totals.astype(np.int64), np.zeros(len(totals), np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        half = int(min((middle - low) * size, counts.sum()))
        if counts.sum() > NUMPY_SLOTS:
            first = _large_draw(_seed(low, high), counts, half)
        else:
            first = _seed(low, high).multivariate_hypergeometric(counts, half, method="marginals")
        if shard < middle:
            counts, high = first, middle
        else:
            before, counts, low = before + first, counts - first, middle
    return counts, before


class Permutation:
    """A keyed permutation of 0 .. n-1.

    Four Feistel rounds permute the next even power of two; an image beyond n is
    sent through again until it lands within.
    """

    def __init__(self, n: int, *key: int):
        self.n = n
        self.half = U(max(1, -(-(n - 1).bit_length() // 2)))
        self.low = U((1 << int(self.half)) - 1)
        self.keys = _seed(*key).integers(0, 2**63, 4).astype(np.uint64)

    def _there(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.low
        for key in self.keys:
            left, right = right, left ^ (mix(right + key) & self.low)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.low
        for key in self.keys[::-1]:
            left, right = right ^ (mix(left + key) & self.low), left
        return left << self.half | right

    def _walk(self, places: np.ndarray, rounds) -> np.ndarray:
        out = rounds(places.astype(np.uint64))
        beyond = np.flatnonzero(out >= U(self.n))
        while len(beyond):
            out[beyond] = rounds(out[beyond])
            beyond = beyond[out[beyond] >= U(self.n)]
        return out.astype(np.int64)

    def images(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self._there)

    def places(self, images: np.ndarray) -> np.ndarray:
        return self._walk(images, self._back)


class Source:
    """One source's words, and how its slots take them."""

    def __init__(self, number: int, name: str | None, size: int, target: float):
        self.number, self.name, self.size, self.target = number, name, size, target
        self.blocks = -(-size // BLOCK)
        self.short = self.blocks * BLOCK - size  # what the last block lacks
        self.passes, self.rest = divmod(int(target), size) if size else (0, 0)
        self.slots = self.passes * self.blocks
        if self.rest:
            self.short_place = int(self.permutation(self.passes).places(np.array([self.blocks - 1]))[0])
            need = -(-self.rest // BLOCK)
            self.slots += need + (int(self.words_before(np.int64(need))) < self.rest)

    def permutation(self, number: int) -> Permutation:
        return Permutation(self.blocks, 1, self.number, number)

    def words_before(self, place):
        """Words of the slots before a place of the last, unfinished pass."""
        return place * BLOCK - np.where(self.short_place < place, self.short, 0)

    def fill(self, first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and words of slots first .. first + count - 1."""
        slots = np.arange(first, first + count)
        passes, places = np.divmod(slots, self.blocks)
        blocks = np.empty(count, np.int64)
        for number in np.unique(passes).tolist():
            own = passes == number
            blocks[own] = self.permutation(number).images(places[own])
        words = np.where(blocks == self.blocks - 1, BLOCK - self.short, BLOCK)
        if self.rest:
            last = passes == self.passes
            words[last] = np.minimum(words[last], self.rest - self.words_before(places[last]))
        return passes, blocks, words


def sources_of(sized: DataFrame) -> list[Source]:
    """All sources with their targets; one row of each passes through the driver."""
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    ordered = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in ordered]
    weights = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(ordered))]
    targets = water_fill(sizes, weights, TOTAL_SHARE * sum(sizes))
    return [
        Source(i, row["source"], size, target)
        for i, (row, size, target) in enumerate(zip(ordered, sizes, targets))
    ]


def draw_slots(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """Write the mix: shard, slot in it, and the source's number, pass, block and words taken."""
    totals = np.array([s.slots for s in sources], np.int64)
    shards = max(1, -(-int(totals.sum()) // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, before = shard_draw(totals, shard, shards, SHARD)
                size = int(counts.sum())
                if not size:
                    continue
                parts = [
                    (np.full(n, s.number), *s.fill(int(b), int(n)))
                    for s, n, b in zip(sources, counts, before)
                    if n
                ]
                number, passes, blocks, words = (np.concatenate(x) for x in zip(*parts))
                slot = Permutation(size, 2, shard).images(np.arange(size))
                columns = [np.full(size, shard), slot, number, passes, blocks, words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=["shard", "slot", "number", "pass", "block", "words"],
                )

    schema = "shard long, slot long, number long, pass long, block long, words long"
    # written, so that its size is known: it grows with the corpus and must not be broadcast
    return written(spark.range(shards).mapInArrow(run, schema), "slots")


def lay_out(sized: DataFrame, sources: list[Source]) -> DataFrame:
    """Every document with words: its source's number and its first word's place there.

    Documents are ordered by hash bucket, then by id and text. A source's words
    are summed within a bucket, and over the buckets before it.
    """
    spark = sized.sparkSession
    names = spark.createDataFrame([(s.name, s.number) for s in sources], "source string, number long")
    buckets = -(-max(1, sized.count()) // BUCKET)
    dealt = (
        sized.where("size > 0")
        .join(names, sized["source"].eqNullSafe(names["source"]))
        .select("number", "doc_id", "text_hash", "size")
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    )
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("number", "bucket").orderBy("doc_id", "text_hash")
    totals = dealt.groupBy("number", "bucket").agg(F.sum("size").alias("held"))
    along = Window.partitionBy("number").orderBy("bucket").rowsBetween(*before)
    offsets = totals.select(
        "number", "bucket", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("bucket_start")
    )
    own = F.coalesce(F.sum("size").over(inside.rowsBetween(*before)), F.lit(0))
    same = Window.partitionBy("number", "bucket", "doc_id", "text_hash").orderBy("size")
    return (
        dealt.withColumn("own_start", own)
        .withColumn("copy", F.row_number().over(same))
        .join(offsets, ["number", "bucket"])
        .withColumn("start", F.col("bucket_start") + F.col("own_start"))
        .select("number", "start", "size", "doc_id", "text_hash", "copy")
    )


def take(layout: DataFrame, slots: DataFrame) -> DataFrame:
    """What slots take of documents: words ``from`` to ``to`` (exclusive) in a pass."""
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    pieces = layout.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.col("block") * BLOCK
    low = F.greatest(F.col("start"), begin) - F.col("start")
    high = F.least(F.col("size"), begin + F.col("words") - F.col("start"))
    return (
        pieces.join(slots.select("number", "block", "pass", "words"), ["number", "block"])
        .select("number", "start", "pass", low.alias("from"), high.alias("to"))
        .where("`from` < `to`")
    )


def size_documents(docs: DataFrame) -> DataFrame:
    """Write doc_id, source, size and hash of the text of every document."""
    return written(
        docs.select(
            "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")
        ),
        "sizes",
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document: sizes, the source's target, and words taken."""
    spark = docs.sparkSession
    sized = size_documents(docs)
    sources = sources_of(sized)
    schema = "number long, source_size long, target double"
    targets = spark.createDataFrame([(s.number, s.size, s.target) for s in sources], schema)
    layout = written(lay_out(sized, sources), "layout")
    takes = take(layout, draw_slots(spark, sources))
    taken = takes.groupBy("number", "start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    with_words = (
        layout.join(taken, ["number", "start"], "left")
        .join(targets, "number")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )
    names = spark.createDataFrame(
        [(s.name, s.size, s.target) for s in sources],
        "name string, source_size long, target double",
    )
    empty = sized.where("size = 0")
    without = empty.join(names, empty["source"].eqNullSafe(names["name"])).select(
        "doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken")
    )
    return with_words.unionByName(without)


_WORD = re.compile(WORD)


def taken_text(text: str, parts: list[dict]) -> str:
    """The words taken, by pass; words that follow each other keep what stands between."""
    spans = [m.span() for m in _WORD.finditer(text)]
    runs: list[list[int]] = []
    at = None
    for number, first, last in sorted((p["pass"], p["from"], p["to"]) for p in parts):
        if at == (number, first):
            runs[-1][1] = last
        else:
            runs.append([first, last])
        at = (number, last)
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each with the words taken of it; those without any are left out."""
    spark = docs.sparkSession
    sized = size_documents(docs)
    sources = sources_of(sized)
    layout = written(lay_out(sized, sources), "layout")
    parts = F.collect_list(F.struct("pass", "from", "to")).alias("parts")
    taken = take(layout, draw_slots(spark, sources)).groupBy("number", "start").agg(parts)
    # equal rows of a source are told apart by counting; the key is that of rows that may be equal
    text = F.xxhash64("text")
    key = lambda text: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    copies = (
        layout.join(taken, ["number", "start"])
        .groupBy(key("text_hash").alias("__key"), F.col("number").alias("__number"))
        .agg(F.map_from_entries(F.collect_list(F.struct("copy", "parts"))).alias("__copies"))
    )
    names = spark.createDataFrame([(s.name, s.number) for s in sources], "__name string, __number long")
    numbered = docs.withColumn("__key", key(text)).join(
        names, docs["source"].eqNullSafe(names["__name"])
    )
    same = Window.partitionBy("__key", "__number").orderBy(F.lit(1))
    chosen = (
        numbered.withColumn("__copy", F.row_number().over(same))
        .join(copies, ["__key", "__number"])
        .withColumn("__parts", F.col("__copies")[F.col("__copy")])
        .where("__parts IS NOT NULL")
        .select(*docs.columns, "__parts")
    )
    at, columns_ = docs.columns.index("text"), docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        taken_parts = columns.pop().to_pylist()
        texts = map(taken_text, columns[at].to_pylist(), taken_parts)
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=columns_)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(chosen, run, types)
