"""Near-duplicates by circulant MinHash, banding and exact Jaccard similarity.

A document's set is its distinct 5-word shingles, A-Z lower-cased; with fewer
words the whole sequence. Shingles are 64-bit hashes. One bijection scatters
them; a second one, shifted circularly by k in the 64-bit universe, gives the
k-th signature coordinate as its smallest value over the set. So two
permutations make all coordinates. 64 of them are cut into 16 bands of 4: two sets
of similarity 0.85 share a band but for 7 pairs in a million.

Equal sets are one class, and only its smallest document id goes on. Classes that
share a band are compared on their full sets:

* in bands of up to ``SMALL`` classes, pair by pair, each pair once;
* in larger ones, block by block: classes are dealt to chunks of about ``CHUNK``
  shingles, every two chunks meet in one task, and of the links found there only
  those are kept that join two parts not joined before.

So no pair is left out, no task holds more than two chunks, and a group of
copies yields fewer links than it has members. Links are joined to components by
repeated small-star and large-star steps on written tables.

Null and empty texts and texts without words have no shingles and are linked with
nothing. Rows with a null id take no part: their component is null and they are
kept. Rows with one id are one document, whose texts may link it to several
others. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import U, mix, slices, small_batches, text_bytes, word_hashes, written

SHINGLE = 5
#: Coordinates of a band, and bands unless more are asked for.
BAND, BANDS = 4, 16
#: Classes of a band that are compared pair by pair, and shingles of a chunk otherwise.
SMALL, CHUNK = 16, 200_000
_SCATTER = U(0x243F6A8885A308D3)
#: The circular shift of a coordinate, times its number.
_SHIFT = U(0x9E3779B97F4A7C15)
_SHINGLE_BASE = U(0x2545F4914F6CDD1D)
#: Shingles whose coordinates are worked out at once, so that they stay in cache.
TILE = 16_384

SIGNED = "doc_id long, n_shingles long, class string, bands array<bigint>"


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, sorted, in a row; and their numbers."""
    words, counts = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
        for i in range(SHINGLE):
            rolled = rolled * _SHINGLE_BASE + words[i : len(words) - SHINGLE + 1 + i]
        rolled = mix(rolled)
        sets, at = [], 0
        for n in counts.tolist():
            if n >= SHINGLE:
                sets.append(np.unique(rolled[at : at + n - SHINGLE + 1]))
            elif n:
                whole = U(n)
                for word in words[at : at + n]:
                    whole = whole * _SHINGLE_BASE + word
                sets.append(mix(np.array([whole], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
            at += n
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def signatures(shingles: np.ndarray, sizes: np.ndarray, coordinates: int = BAND * BANDS) -> np.ndarray:
    """That many values for every set that is not empty; rows of empty sets are full."""
    out = np.full((len(sizes), coordinates), ~U(0), np.uint64)
    shifts = np.arange(coordinates, dtype=np.uint64) * _SHIFT
    ends = np.cumsum(sizes)
    filled = np.flatnonzero(sizes)
    first = 0
    while first < len(filled):
        # as many sets as fit in a tile, one at least
        base = ends[filled[first]] - sizes[filled[first]]
        last = max(int(np.searchsorted(ends[filled], base + TILE, side="right")), first + 1)
        own = filled[first:last]
        part = mix(shingles[base : ends[own[-1]]] ^ _SCATTER)
        starts = ends[own] - sizes[own] - base
        for k in range(coordinates):
            shifted = part - shifts[k]
            shifted ^= shifted >> U(32)
            shifted *= U(0xD6E8FEB86659FD93)
            shifted ^= shifted >> U(32)
            shifted *= U(0xD6E8FEB86659FD93)
            out[own, k] = np.minimum.reduceat(shifted, starts)
        first = last
    return out


def _sign(n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = text_bytes(batch.column(1))
            for a, b in slices(texts):
                shingles, sizes = shingle_sets(texts[a:b])
                signed = signatures(shingles, sizes, BAND * n_bands)
                bands = np.zeros((len(sizes), n_bands), np.uint64)
                for i in range(n_bands):
                    key = np.full(len(sizes), U(i), np.uint64)
                    for j in range(BAND):
                        key = mix(key * _SHINGLE_BASE + signed[:, i * BAND + j])
                    bands[:, i] = key
                ends = np.cumsum(sizes)
                names = [
                    hashlib.md5(shingles[e - n : e].tobytes()).hexdigest() if n else None
                    for n, e in zip(sizes.tolist(), ends.tolist())
                ]
                flat = pa.array(bands.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(sizes),
                        pa.array(names, pa.string()),
                        pa.FixedSizeListArray.from_arrays(flat, n_bands).cast(pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "class", "bands"],
                )

    return run


def sign(docs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """Write size, class and bands of every document's set."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return written(texts.mapInArrow(_sign(n_bands), SIGNED), "signed")


def _linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_cent * (len(a) + len(b) - both)


def _sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    texts = text_bytes(column)
    for a, b in slices(texts):
        shingles, sizes = shingle_sets(texts[a:b])
        yield from np.split(shingles, np.cumsum(sizes)[:-1])


def _verify_pairs(per_cent: int):
    """Rows (a, b, text) sorted by a, of which those with a null b have a's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sets = None, []
        for batch in small_batches(batches):
            links = []
            rows = zip(
                batch.column("a").to_pylist(),
                batch.column("b").to_pylist(),
                _sets_of(batch.column("text")),
            )
            for a, b, found in rows:
                if a != own:
                    own, sets = a, []
                if b is None:
                    sets.append(found)
                elif any(_linked(s, found, per_cent) for s in sets):
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"]
                )

    return run


def forest(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, per_cent: int) -> list:
    """Links that join the parts of a block; members of one side are not compared.

    ``left`` is true for members of the first chunk and false for the second; where
    a block is one chunk all are compared.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    flags = np.zeros(int(flat.max()) + 1, np.int64)
    one_chunk = bool(left.all())
    links = []
    for i in range(len(sets)) if one_chunk else np.flatnonzero(left).tolist():
        own = flat[ends[i] - sizes[i] : ends[i]]
        flags[own] = 1
        first = i + 1 if one_chunk else int(np.argmin(left))
        if first < len(sets):
            begin = ends[first] - sizes[first]
            both = np.add.reduceat(flags[flat[begin:]], ends[first:] - sizes[first:] - begin)
            near = 100 * both >= per_cent * (sizes[i] + sizes[first:] - both)
            for j in (np.flatnonzero(near) + first).tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[a] = b
                    links.append((int(ids[i]), int(ids[j])))
        flags[own] = 0
    return links


def _verify_blocks(per_cent: int):
    """Rows (block, side, id, text) sorted by block and side: links of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.array([h[0] for h in held])
            left = np.array([h[1] for h in held]) == 0
            links = forest(ids, [h[2] for h in held], left, per_cent)
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"]
                )

        for batch in small_batches(batches):
            rows = zip(
                batch.column("block").to_pylist(),
                batch.column("side").to_pylist(),
                batch.column("id").to_pylist(),
                _sets_of(batch.column("text")),
            )
            for block, side, name, found in rows:
                if block != own:
                    if held:
                        yield from flush()
                    own, held = block, []
                if len(found):
                    held.append((name, side, found))
        if held:
            yield from flush()

    return run


def class_ids(signed: DataFrame) -> DataFrame:
    """Every class that has words and its smallest document id ``rep``."""
    return (
        signed.where("class IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("class", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"))
    )


def find_links(docs: DataFrame, signed: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) between documents; written."""
    reps = written(class_ids(signed), "classes")
    bands = reps.select(
        F.col("rep").alias("id"),
        F.col("n_shingles").alias("n"),
        F.explode("bands").alias("band"),
    )
    counts = (
        bands.groupBy("band")
        .agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
        .where("members > 1")
    )
    crowded = written(bands.join(counts, "band"), "crowded")
    small = crowded.where(F.col("members") <= SMALL).select("band", "id", "n")
    a, b = small.alias("a"), small.alias("b")
    # sizes that differ by more than the similarity allows cannot be linked
    fits = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * per_cent
    pairs = written(
        a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.id") < F.col("b.id")) & fits)
        .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        .distinct(),
        "pairs",
    )
    large = crowded.where(F.col("members") > SMALL)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    # the wanted ids grow with the corpus: they are never broadcast
    texts = written(texts.join(wanted.distinct().hint("merge"), "id"), "texts")

    first = pairs.select(F.col("a").alias("id")).distinct().join(texts, "id")
    second = pairs.join(texts, F.col("b") == F.col("id")).select("a", "b", "text")
    rows = first.select(F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "text")
    by_pairs = (
        rows.unionByName(second)
        .repartition("a")
        .sortWithinPartitions("a", F.col("b").asc_nulls_first())
        .mapInArrow(_verify_pairs(per_cent), "a long, b long")
    )

    chunks = F.ceil(F.col("shingles") / CHUNK).cast("int")
    dealt = (
        large.withColumn("chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "id",
            F.concat_ws(":", "band", F.least("chunk", "other"), F.greatest("chunk", "other")).alias(
                "block"
            ),
            (F.col("chunk") > F.col("other")).cast("int").alias("side"),
        )
    )
    by_blocks = (
        dealt.join(texts, "id")
        .select("block", "side", "id", "text")
        .repartition("block")
        .sortWithinPartitions("block", "side", "id")
        .mapInArrow(_verify_blocks(per_cent), "a long, b long")
    )

    # one id may stand for several classes
    named = signed.where("class IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "class")
    own = named.join(reps.select("class", "rep"), "class").select("doc_id", "rep").distinct()
    several = (
        own.withColumnRenamed("doc_id", "a")
        .where("a != rep")
        .join(
            own.groupBy(F.col("doc_id").alias("a"))
            .agg(F.count("*").alias("n"))
            .where("n > 1")
            .select("a"),
            "a",
        )
        .select("a", F.col("rep").alias("b"))
    )
    return written(by_pairs.unionByName(by_blocks).unionByName(several).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, for every id in a link."""

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    edges = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    edges = written(edges.where("u < v").distinct(), "edges")
    before = mark(edges)
    while True:
        # every node points its larger neighbours at its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v")
        large = large.where("u < v").distinct()
        # every node points its smaller neighbours and itself at the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select("m", F.explode(F.array("u", "v")).alias("v"))
            .where("m < v")
            .select(F.col("m").alias("u"), "v")
            .distinct()
        )
        edges = written(small, "edges")
        after = mark(edges)
        if after == before:
            return edges.select(F.col("v").alias("id"), F.col("u").alias("root"))
        before = after


def near_duplicates(docs: DataFrame, per_cent: int = 85, n_bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two sets are linked if 100 * intersection >= per_cent * union. A pair of similarity s
    shares no band, and is missed, with a chance of (1 - s^4)^n_bands.
    """
    signed = sign(docs, n_bands)
    roots = components(find_links(docs, signed, per_cent))
    reps = class_ids(signed).select("class", "rep")
    # an id with several classes is in the links, so either way leads to its root
    own = signed.join(reps, "class", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    joined = own.join(roots, own["rep"] == roots["id"], "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep"))
    return joined.select(
        "doc_id",
        "n_shingles",
        root.alias("component_id"),
        F.col("doc_id").eqNullSafe(root).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, per_cent: int = 80, n_bands: int = 24) -> DataFrame:
    """One row of each component, with its columns; rows are judged by their texts alone.

    Every row is a document of its own, whatever its id: rows with one id, or none, are
    linked only if their texts are alike. The row with the smallest id stays, null last;
    of one id any row may, the same in every run over one table. Rows without words all stay.
    """
    row = "__row_of_near_dedup"
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), per_cent, n_bands)
    rank = F.struct(F.col("id").isNull(), "id", F.col("doc_id"))
    ids = keyed.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("id"))
    first = (
        found.join(ids, "doc_id")
        .groupBy("component_id")
        .agg(F.min_by("doc_id", rank).alias(row))
        .select(row)
    )
    # the rows that stay grow with the corpus: they are never broadcast
    return keyed.join(first.hint("merge"), row, "left_semi").select(*docs.columns)
