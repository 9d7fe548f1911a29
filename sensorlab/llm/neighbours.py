"""Approximate nearest neighbours by multiprobe p-stable hashing.

The measure is the inner product. Vectors are divided by the largest norm and get
one more component that makes their norm 1; queries are divided by their own
norm. The nearest by distance are then those of the largest inner product.

Each of ``TABLES`` tables has Gaussian projections cut into intervals; a bucket is
one interval of every projection. For a query, the chance that a near vector lies
in a bucket is the product of normal probabilities of its intervals, given the
query's own projections. Buckets are visited in the order of that chance until
the visited ones hold ``SUCCESS`` of it; the chance of the last one visited is
estimated by draws. Vectors of the visited buckets, merged over the tables, are
ranked by the exact inner product in double precision.

The first projections name the block a bucket lies in. A query goes only to blocks that
can hold a bucket it visits, and meets there the vectors of the visited buckets alone.
Blocks of more than ``CHUNK`` vectors are dealt to several. A query whose buckets would
hold over ``MOST_SHARE`` of all vectors, by a sample, is held against all of them once,
in blocks of ``ALL_BYTES``: without near vectors hashing saves nothing. Equal vectors
are one entry with the smallest ids that any result can hold, so copies do not crowd a
block, and no copy is lost.

A search leaves out what lies below the k + 1 nearest that the query has found before, and the search
of all vectors also what lies below its k + 1 nearest of the sample: neither can be in the result. A
task keeps the k + 1 nearest of every query over all blocks it meets, and these meet query by query.

Every query has its own similarity of a near vector: at first that of its k-th
nearest in a sample of at most ``SAMPLE_ROWS`` vectors, or, where the sample is expected to
hold fewer than ``RELIABLE`` of the k nearest, the first of ``LADDER``. A query whose k-th
found lies further off than that by more than ``SLACK`` searches once more, for the next of
``LADDER`` or, if that is more, the similarity it found, which its true k-th nearest has
at least. All vectors are indexed.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows with a null id. Rows with one id
and equal vectors are one. A query whose buckets held fewer than k others is
held against all vectors, in blocks, so it gets k, or all there are; an empty
table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlab.llm.common import written

TABLES, SUCCESS = 2, 0.72
#: Projections of a table at least, and those beyond the ones that name a block.
PROJECTIONS, BEYOND = 6, 4
#: Width of an interval, and intervals on either side of zero; the outer ones are open.
WIDTH, SIDE = 1.0, 3
CHUNK, SAMPLE_ROWS, DRAWS = 2048, 20_000, 400
#: Numbers that the sample holds at most, and its rows that estimate what a query's buckets hold.
SAMPLE_VALUES, SHARE_ROWS = 4_000_000, 2048
#: Share of all vectors above which a query meets all of them, and bytes of a block of all vectors.
MOST_SHARE, ALL_BYTES = 0.4, 4_000_000
#: Highest similarity looked for, and growth of 1 - similarity that no search is repeated for. The
#: lowest is 0: from there on, nearer vectors lie at least as often in the buckets visited.
MOST, SLACK = 0.95, 1.05
#: Similarities looked for in turn, and sampled neighbours that make the sample's own one good enough.
LADDER, RELIABLE = (0.95, 0.85, 0.7), 4
QUERY_ROWS = 256
#: Share of a chunk's pairs from which a matrix product of all of them costs less than picking them.
DENSE_SHARE = 1 / 8
#: Vectors that are multiplied one by one at once, and pairs that a task holds before it ranks them.
PICKED_ROWS, HELD_PAIRS = 16_384, 500_000
SEED = 29
FOUND = "vec_id long, ids array<bigint>, scores array<double>"


def _cdf(x: np.ndarray) -> np.ndarray:
    errors = map(math.erf, (x / math.sqrt(2)).ravel().tolist())
    return 0.5 * (1 + np.fromiter(errors, float, x.size).reshape(x.shape))


class Index:
    """Projections and constants; the same on every task. ``near`` is of queries without their own."""

    def __init__(self, dim: int, rows: int, norm: float, near: float, k: int):
        self.dim, self.rows, self.norm, self.near, self.k = dim, rows, norm, near, k
        self.prefix = max(0, round(math.log(max(rows, 1) / CHUNK, 4)))
        self.projections = max(PROJECTIONS, self.prefix + BEYOND)
        rng = np.random.default_rng(SEED)
        self.lines = rng.standard_normal((TABLES, dim + 1, self.projections))
        self.shifts = rng.random((TABLES, self.projections))

    def reliable(self, sampled: int) -> bool:
        return self.k * sampled >= RELIABLE * self.rows

    def codes(self, table: int, vectors: np.ndarray) -> np.ndarray:
        """Interval numbers, 0 .. 2 * SIDE - 1, of vectors."""
        scaled = vectors / self.norm
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
        places = np.c_[scaled, rest] @ self.lines[table] / WIDTH + self.shifts[table]
        return np.clip(np.floor(places).astype(np.int64) + SIDE, 0, 2 * SIDE - 1)

    def chances(
        self, table: int, queries: np.ndarray, near: np.ndarray | None = None
    ) -> np.ndarray:
        """Log chance of every interval: queries x projections x intervals."""
        own = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        near = np.full(len(own), self.near) if near is None else near
        lines = self.lines[table][:-1]
        along = own @ lines
        centre = near[:, None] * along
        # what is not along the query points anywhere, so a line shows its own length of it
        across = np.maximum((lines**2).sum(axis=0) - along**2, 0) / max(1, self.dim - 1)
        spread = np.sqrt(np.maximum(1e-6, (1 - near**2)[:, None] * across))[:, :, None]
        edges = (np.arange(1 - SIDE, SIDE) - self.shifts[table][:, None]) * WIDTH
        below = _cdf((edges[None] - centre[:, :, None]) / spread)
        ones, zeros = np.ones_like(below[:, :, :1]), np.zeros_like(below[:, :, :1])
        mass = np.diff(np.concatenate((zeros, below, ones), axis=2), axis=2)
        return np.log(np.maximum(mass, 1e-12))

    def cutoffs(self, chances: np.ndarray) -> np.ndarray:
        """Log chance of the last bucket to visit, for every query."""
        rng = np.random.default_rng(SEED + 1)
        picks = rng.random((DRAWS, chances.shape[1]))
        below = np.cumsum(np.exp(chances), axis=2)
        below /= below[:, :, -1:]
        out = np.empty(len(chances))
        for i, (chance, edge) in enumerate(zip(chances, below)):
            drawn = (picks[:, :, None] > edge[None]).sum(axis=2).clip(0, 2 * SIDE - 1)
            sums = chance[np.arange(chance.shape[0])[None], drawn].sum(axis=1)
            out[i] = np.quantile(sums, 1 - SUCCESS)
        return out

    def marks(self, codes: np.ndarray, first: int = 0) -> np.ndarray:
        """A one in the place of every interval, from projection ``first`` on."""
        out = np.zeros((len(codes), (self.projections - first) * 2 * SIDE), np.float32)
        steps = np.arange(self.projections - first) * 2 * SIDE
        out[np.arange(len(codes))[:, None], codes[:, first:] + steps] = 1
        return out

    def blocks(self, chance: np.ndarray, cutoff: float) -> list[str]:
        """Names of the blocks that can hold a visited bucket."""
        rest = chance[self.prefix :].max(axis=1).sum()
        best = np.r_[np.cumsum(chance[: self.prefix].max(axis=1)[::-1])[::-1], 0.0]
        found = [("", 0.0)]
        for i in range(self.prefix):
            found = [
                (name + str(v), held + chance[i, v])
                for name, held in found
                for v in range(2 * SIDE)
                if held + chance[i, v] + best[i + 1] + rest >= cutoff
            ]
        return [name for name, _ in found]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = (
        embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector"))
        .where("vec_id IS NOT NULL AND vector IS NOT NULL")
        .where(finite & F.exists("vector", lambda x: x != 0))
    )
    return rows


def _fit(entries: DataFrame, k: int) -> tuple[Index, np.ndarray, np.ndarray] | None:
    """The index, a sample of the vectors, divided by the largest norm, and the places of its distinct ids."""
    lengths = entries.groupBy(F.size("vector").alias("dim")).agg(
        F.count("*").alias("n"),
        F.max(F.expr("aggregate(vector, 0D, (s, x) -> s + x * x)")).alias("square"),
    )
    top = lengths.orderBy(F.desc("n"), "dim").first()
    if top is None:
        return None
    dim, rows, norm = top["dim"], top["n"], math.sqrt(top["square"])
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
    share = min(1.0, 1.2 * most / rows)
    sample = entries.where(F.size("vector") == dim).where(
        F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    )
    order = sample.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(most)
    table = order.select("vec_id", "vector").toArrow()
    found = _matrix(table["vector"].combine_chunks())
    _, own = np.unique(table["vec_id"].to_numpy(), return_index=True)
    return Index(dim, rows, norm, 0.0, k), (found.reshape(-1, dim) / norm).astype(np.float32), own


def _margin(dim: int) -> float:
    """More than single precision loses of a product of two vectors of norm 1 at most."""
    return (dim + 8) * 1.2e-7


def _own_near(index: Index, sample: np.ndarray, own_ids: np.ndarray):
    """Adds every query's similarity to the k-th nearest, by the sample, its scale of scores, and a
    similarity that k + 1 vectors of the sample have at least (null where it holds fewer)."""
    # place in the sample of the k-th nearest of all; the query itself may be first
    place = min(len(sample) - 1, max(1, math.ceil(index.k * len(sample) / index.rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(at, QUERY_ROWS)
                vectors = _matrix(part.column("vector"))
                norms = np.linalg.norm(vectors, axis=1)
                near, bounds = np.zeros(len(vectors)), None
                scores = (vectors / norms[:, None]).astype(np.float32) @ sample.T
                if not index.reliable(len(sample)):
                    near = np.full(len(vectors), LADDER[0])
                elif place >= 0:
                    near = np.partition(scores, len(sample) - 1 - place, axis=1)
                    near = near[:, len(sample) - 1 - place].astype(float).clip(0.0, MOST)
                if len(own_ids) > index.k:
                    # entries of one id might be one pair of id and score
                    alone = scores if len(own_ids) == len(sample) else scores[:, own_ids]
                    edge = alone.shape[1] - 1 - index.k
                    bounds = np.partition(alone, edge, axis=1)[:, edge].astype(float) - _margin(index.dim)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"),
                        part.column("vector"),
                        pa.array(near),
                        pa.array(norms * index.norm),
                        pa.nulls(len(vectors), pa.float64()) if bounds is None else pa.array(bounds),
                    ],
                    names=["vec_id", "vector", "near", "scale", "bound"],
                )

    return run


def entries_of(vectors: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: its smallest id, and the k + 1 smallest ids."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = vectors.distinct().withColumn("place", F.row_number().over(order))
    return (
        first.where(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
        .select(F.col("members")[0].alias("vec_id"), "members", "vector")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _index_rows(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"))
            for table in range(TABLES):
                codes = index.codes(table, vectors)
                names = ["".join(map(str, c)) for c in codes[:, : index.prefix].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{table}:{name}" for name in names]),
                        batch.column("vec_id"),
                        batch.column("members"),
                        pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32())),
                        batch.column("vector"),
                    ],
                    names=["block", "vec_id", "members", "codes", "vector"],
                )

    return run


def _query_rows(index: Index, sample: np.ndarray):
    """The blocks that a query visits and its last bucket's chance in each; none if it is to meet all vectors."""
    some = sample[:SHARE_ROWS].astype(float) * index.norm
    marks = [index.marks(index.codes(table, some)).T for table in range(TABLES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(at, QUERY_ROWS)
                vectors = _matrix(part.column("vector"))
                near = part.column("near").to_numpy(zero_copy_only=False)
                # a negative similarity asks for all vectors
                plans, share = [], np.where(near < 0, 1.0, 0.0)
                near = np.maximum(near, 0.0)
                for table in range(TABLES):
                    chances = index.chances(table, vectors, near)
                    cutoffs = index.cutoffs(chances)
                    flat = chances.reshape(len(vectors), -1).astype(np.float32)
                    if len(some):
                        share += (flat @ marks[table] >= cutoffs[:, None]).mean(axis=1)
                    plans.append((chances, cutoffs))
                blocks, cutoffs = [], []
                for i in range(len(vectors)):
                    if share[i] > MOST_SHARE:
                        blocks.append(None)
                        cutoffs.append(None)
                        continue
                    names, last = [], []
                    for table, (chances, cutoff) in enumerate(plans):
                        own = index.blocks(chances[i], cutoff[i])
                        names += [f"{table}:{name}" for name in own]
                        last += [float(cutoff[i])] * len(own)
                    blocks.append(names)
                    cutoffs.append(last)
                kept = ("vec_id", "near", "floor", "bound", "vector")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blocks, pa.list_(pa.string())),
                        pa.array(cutoffs, pa.list_(pa.float64())),
                        *[part.column(name) for name in kept],
                    ],
                    names=["blocks", "cutoffs", *kept],
                )

    return run


def _best(most: int, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``most`` best distinct pairs of every query, queries in order; ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    other = query[1:] != query[:-1]
    fresh = np.ones(len(query), bool)
    fresh[1:] = other | (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
    query, ids, scores = query[fresh], ids[fresh], scores[fresh]
    kept = _ranks(query) < most
    return query[kept], ids[kept], scores[kept]


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Place of every row in its group; rows of a group lie together."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]][: len(groups)])
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def _found_rows(query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """A row for every query; its pairs lie together."""
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
    offsets = pa.array(np.r_[starts, len(query)].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query[starts]),
            pa.ListArray.from_arrays(offsets, pa.array(ids)),
            pa.ListArray.from_arrays(offsets, pa.array(scores)),
        ],
        names=["vec_id", "ids", "scores"],
    )


def _merge(most: int):
    """Rows sorted by query: the best of what was found of every query, in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the best so far of the last query, of which further rows may come
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            lengths = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)
            rows = (
                np.repeat(batch.column("vec_id").to_numpy(), lengths),
                *(batch.column(name).flatten().to_numpy(zero_copy_only=False) for name in ("ids", "scores")),
            )
            if not len(rows[0]):
                continue
            best = _best(most, *(np.concatenate(x) for x in zip(held, rows)))
            cut = np.searchsorted(best[0], best[0][-1])
            held = tuple(x[cut:] for x in best)
            if cut:
                yield _found_rows(*(x[:cut] for x in best))
        if len(held[0]):
            yield _found_rows(*held)

    return run


class _Chunk:
    """Entries of a chunk, and the buckets they lie in; a chunk of all vectors has no buckets."""

    def __init__(self, index: Index, name: str, entries: list[pa.RecordBatch]):
        base = pa.Table.from_batches(entries).combine_chunks()
        self.index = index
        self.vectors = _matrix(base["vector"].combine_chunks())
        self.unit = (self.vectors / index.norm).astype(np.float32)
        members = base["members"].combine_chunks()
        self.lengths = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.members = members.flatten().to_numpy(zero_copy_only=False)
        table, self.block = name.split(":")[:2]
        self.table = None if table == "all" else int(table)
        if self.table is not None:
            codes = _matrix(base["codes"].combine_chunks())[:, index.prefix :]
            buckets, self.bucket = np.unique(codes, axis=0, return_inverse=True)
            self.bucket = self.bucket.ravel()
            first = np.zeros((len(buckets), index.prefix), buckets.dtype)
            self.marks = index.marks(np.c_[first, buckets], index.prefix).T

    def visited(self, part: pa.RecordBatch, own: np.ndarray) -> np.ndarray:
        """Whether an entry lies in a bucket that a query visits: queries x entries."""
        near = part.column("near").to_numpy(zero_copy_only=False)
        cutoffs = part.column("cutoff").to_numpy(zero_copy_only=False)
        chances = self.index.chances(self.table, own, near)
        prefix = self.index.prefix
        held = sum((chances[:, i, int(v)] for i, v in enumerate(self.block)), np.zeros(len(own)))
        rest = chances[:, prefix:].reshape(len(own), -1).astype(np.float32) @ self.marks
        # the margin is that of sums in single precision
        return (rest + held[:, None] >= cutoffs[:, None] - 1e-4)[:, self.bucket]

    def candidates(self, part: pa.RecordBatch, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and entries to rank exactly, in the order of the queries."""
        most = self.index.k + 1
        visited = None if self.table is None else self.visited(part, own)
        if visited is not None and np.count_nonzero(visited) < DENSE_SHARE * visited.size:
            return np.nonzero(visited)
        norms = np.linalg.norm(own, axis=1)
        scores = (own / norms[:, None]).astype(np.float32) @ self.unit.T
        if visited is not None:
            scores[~visited] = -np.inf
        edges = _known(part, "floor") / (norms * self.index.norm)
        if visited is None:
            edges = np.fmax(edges, _known(part, "bound"))
        free = np.flatnonzero(edges == -np.inf)
        if len(free) and scores.shape[1] > most:
            edges[free] = np.partition(scores[free], -most, axis=1)[:, -most]
        # what was not visited stays below any edge
        edges = np.maximum(edges - 2 * _margin(self.index.dim), -1e30)
        return np.nonzero(scores >= edges[:, None].astype(np.float32))

    def nearest(self, queries: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (query, id, score) of the nearest entries of every query, ties and copies included."""
        most = self.index.k + 1
        for at in range(0, queries.num_rows, QUERY_ROWS):
            part = queries.slice(at, QUERY_ROWS)
            own = _matrix(part.column("vector"))
            rows, places = self.candidates(part, own)
            exact = np.empty(len(rows))
            for i in range(0, len(rows), PICKED_ROWS):
                some = slice(i, i + PICKED_ROWS)
                exact[some] = (self.vectors[places[some]] * own[rows[some]]).sum(axis=1)
            live = exact >= _known(part, "floor")[rows]
            rows, places, exact = rows[live], places[live], exact[live]
            if not len(rows):
                continue
            order = np.lexsort((-exact, rows))
            rows, places, exact = rows[order], places[order], exact[order]
            ranks = _ranks(rows)
            edges = np.full(len(own), -np.inf)
            last = ranks == most - 1
            edges[rows[last]] = exact[last]
            live = exact >= edges[rows]
            rows, places, exact = rows[live], places[live], exact[live]
            lengths = self.lengths[places]
            within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            ids = self.members[np.repeat(self.starts[places], lengths) + within]
            names = part.column("vec_id").to_numpy()[rows]
            yield np.repeat(names, lengths), ids, np.repeat(exact, lengths)


def _known(part: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of numbers, minus infinity where there is none."""
    values = part.column(column).to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(values), -np.inf, values)


def _search(index: Index):
    """Rows sorted by chunk, entries before queries: the nearest of every query in the task's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, entries, chunk = None, [], None
        held, size = [], 0
        for batch in batches:
            chunks = batch.column("chunk").to_pylist()
            kinds = batch.column("is_query").to_pylist()
            start = 0
            while start < len(chunks):
                end = start
                key = (chunks[start], kinds[start])
                while end < len(chunks) and (chunks[end], kinds[end]) == key:
                    end += 1
                part = batch.slice(start, end - start)
                start = end
                if key[0] != own:
                    own, entries, chunk = key[0], [], None
                if not key[1]:
                    entries.append(part)
                elif entries:
                    chunk = chunk or _Chunk(index, own, entries)
                    for pairs in chunk.nearest(part):
                        held.append(pairs)
                        size += len(pairs[0])
                        if size >= HELD_PAIRS:
                            best = _best(index.k + 1, *(np.concatenate(x) for x in zip(*held)))
                            held, size = [best], len(best[0])
                            # ranking again and again what stays would cost more than moving it
                            if size > HELD_PAIRS / 2:
                                yield _found_rows(*best)
                                held, size = [], 0
        if held:
            yield _found_rows(*_best(index.k + 1, *(np.concatenate(x) for x in zip(*held))))

    return run


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every query.

    Queries are the rows whose id is divisible by ``every``.
    """
    empty = embeddings.sparkSession.createDataFrame(
        [], "query_id long, rank int, vec_id long, score double"
    )
    vectors = usable(embeddings)
    entries = written(entries_of(vectors, k), "vectors")
    fitted = _fit(entries, k)
    if fitted is None:
        return empty
    index, sample, own_ids = fitted
    entries = entries.where(F.size("vector") == index.dim)
    asked = vectors.where((F.col("vec_id") % every == 0) & (F.size("vector") == index.dim))
    asked = asked.distinct().withColumnRenamed("vec_id", "query_id")
    asked = written(
        asked.join(entries.select("vec_id", "vector"), "vector").select(
            "query_id", "vec_id", "vector"
        ),
        "queries",
    )
    base = written(
        entries.mapInArrow(
            _index_rows(index),
            "block string, vec_id long, members array<bigint>, codes array<int>, vector array<double>",
        ),
        "index",
    )
    chunks = base.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = base.join(chunks, "block").select(
        F.concat_ws(":", "block", F.pmod(F.xxhash64("vec_id"), "chunks")).alias("chunk"),
        "vec_id",
        "members",
        "codes",
        "vector",
    )
    parts = math.ceil(index.rows * index.dim * 8 / ALL_BYTES)
    dealt_all = entries.select(
        F.concat(F.lit("all:"), F.pmod(F.xxhash64("vec_id"), F.lit(parts))).alias("chunk"),
        "vec_id",
        "members",
        F.lit(None).cast("array<int>").alias("codes"),
        "vector",
    )

    def held_against(base_rows: DataFrame, probes: DataFrame) -> DataFrame:
        rows = base_rows.withColumn("is_query", F.lit(False)).unionByName(
            probes.select(
                "chunk", "vec_id", "cutoff", "near", "floor", "bound", "vector", F.lit(True).alias("is_query")
            ),
            allowMissingColumns=True,
        )
        limits = ["cutoff", "near", "floor", "bound"]
        columns = ["chunk", "is_query", "vec_id", *limits, "members", "codes", "vector"]
        return (
            rows.select(*columns)
            .repartition("chunk")
            .sortWithinPartitions("chunk", "is_query")
            .mapInArrow(_search(index), FOUND)
        )

    def merged_of(found: DataFrame) -> DataFrame:
        """The best k + 1 of what was found of every query; ties to the smaller id."""
        return found.repartition("vec_id").sortWithinPartitions("vec_id").mapInArrow(_merge(k + 1), FOUND)

    def search(visits: DataFrame, whole: DataFrame) -> DataFrame:
        """Best entries of every query over the blocks it visits, or over all vectors, task by task."""
        probes = visits.join(chunks, "block").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        )
        found = held_against(dealt, probes.withColumn("chunk", F.concat_ws(":", "block", "part")))
        if not whole.isEmpty():
            part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
            probes = whole.withColumn("cutoff", F.lit(0.0)).withColumn("part", part)
            probes = probes.withColumn("chunk", F.concat(F.lit("all:"), "part"))
            found = found.unionByName(held_against(dealt_all, probes))
        return found

    queries = asked.select("vec_id", "vector").dropDuplicates(["vec_id"])
    queries = written(
        queries.mapInArrow(
            _own_near(index, sample, own_ids),
            "vec_id long, vector array<double>, near double, scale double, bound double",
        ).withColumn("floor", F.lit(None).cast("double")),
        "near",
    )

    def planned(rows: DataFrame) -> DataFrame:
        rows = rows.select("vec_id", "vector", "near", "floor", "bound").mapInArrow(
            _query_rows(index, sample),
            "blocks array<string>, cutoffs array<double>, vec_id long, near double, floor double, "
            "bound double, vector array<double>",
        )
        return written(rows, "visits")

    # with a good sample no step of the ladder is taken
    steps = () if index.reliable(len(sample)) else LADDER[1:]
    below = F.lit(-1.0)
    for step in reversed(steps):
        below = F.when(F.col("near") > step, step).otherwise(below)
    last = F.when(F.size("ids") > k, F.element_at("scores", -1))
    further = (F.col("near") > 0) & (1 - F.col("reached") > SLACK * (1 - F.col("near")))
    looking, before, results = queries, None, []
    while True:
        plan = planned(looking)
        whole = plan.where("blocks IS NULL")
        visits = plan.select(
            "vec_id", "near", "floor", "bound", "vector", F.inline(F.arrays_zip("blocks", "cutoffs"))
        ).withColumnsRenamed({"blocks": "block", "cutoffs": "cutoff"})
        found = search(visits, whole)
        found = written(merged_of(found if before is None else found.unionByName(before)), "found")
        # what was not held against all, and found too few or further ones than it looked for
        judged = (
            looking.join(whole.select("vec_id"), "vec_id", "left_anti")
            .join(found, "vec_id", "left")
            .withColumn("last", last)
            .withColumn("reached", F.col("last") / F.col("scale"))
            .where(F.col("reached").isNull() | further)
        )
        # beyond the ladder those with too few meet all, others look for what they found
        least = F.when(F.col("reached").isNull(), below).otherwise(
            F.greatest(F.col("reached"), below, F.lit(0.0))
        )
        looking = written(
            judged.withColumn("near", least)
            .withColumn("floor", F.col("last"))
            .select("vec_id", "vector", "near", "scale", "bound", "floor"),
            "again",
        )
        if looking.isEmpty():
            results.append(found)
            break
        results.append(found.join(looking.select("vec_id"), "vec_id", "left_anti"))
        before = found.join(looking.select("vec_id"), "vec_id", "left_semi")
    merged = reduce(DataFrame.unionByName, results)
    pairs = F.expr("filter(arrays_zip(ids, scores), p -> p.ids != query_id)")
    return (
        asked.select("query_id", "vec_id")
        .join(merged, "vec_id")
        .select("query_id", F.posexplode(F.slice(pairs, 1, k)).alias("place", "pair"))
        .select(
            "query_id",
            (F.col("place") + 1).cast("int").alias("rank"),
            F.col("pair.ids").alias("vec_id"),
            F.col("pair.scores").alias("score"),
        )
    )
