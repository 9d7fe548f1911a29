"""Periodic runs of words, found by block convolution, and texts without their repeats.

A run is a stretch of words with smallest period q, of at least max(6, 4 q) words,
that no neighbouring word extends keeping the period.

At every dyadic scale P, for periods from P to under 2 P, words are cut into blocks
of P. A number theoretic transform gives, for each block and each distance d of
that range, the sum of squared differences between the block's word numbers and
those d words later, modulo ``PRIME``; where that is not zero, block and copy differ.
A run holds two blocks in a row that are zero at its period, and only such distances
seed. From a seed, words are compared one with another to both sides, so a
sum that is a multiple of the prime by chance costs a comparison and no more.
Distances that are a multiple of a known run's period within it are passed over:
they extend to that run again. There are at most as many repeats as words, so the
work grows as the number of words times the squared logarithm, whatever they are.

Transforms are exact: they are products with matrices of residues, whose sums stay
below 2^53 in doubles; long ones are split into two steps.

Null and empty texts and texts without words have no run and an empty collapsed
text. Rows are read one by one, so repeated rows give equal results; columns of the
table that clash with a result column are replaced; an empty table gives
an empty table.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import map_arrow, slices, text_bytes

#: 3 * 2^18 + 1: sums of up to 2^13 products of residues are exact in doubles.
PRIME = 786_433
#: Longest block, so that a transform of twice its length exists.
BLOCK = 1 << 17
#: Length of the transforms that are one matrix product, and numbers that one step takes at once.
LEAF, TILE = 64, 32_768
LEAST, TIMES = 6, 4

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _reduce(x: np.ndarray) -> np.ndarray:
    """Residues, in place; at most one multiple of the prime off the usual range."""
    q = np.floor(x * (1 / PRIME))
    q *= PRIME
    x -= q
    return x


@lru_cache(maxsize=1)
def _generator() -> int:
    return next(g for g in range(2, PRIME) if all(pow(g, (PRIME - 1) // f, PRIME) != 1 for f in (2, 3)))


@lru_cache(maxsize=64)
def _roots(rows: int, columns: int, order: int, inverse: bool) -> np.ndarray:
    """w^(row * column) for a root w of unity of that order."""
    w = pow(_generator(), (PRIME - 1) // order, PRIME)
    w = pow(w, -1, PRIME) if inverse else w
    powers = np.ones(order, np.int64)
    for i in range(1, order):
        powers[i] = powers[i - 1] * w % PRIME
    return powers[np.outer(np.arange(rows), np.arange(columns)) % order].astype(np.float64)


def transform(x: np.ndarray) -> np.ndarray:
    """Transform of every row, in an order that ``inverse`` undoes."""
    rows, n = x.shape
    if n <= LEAF:
        return _reduce(x @ _roots(n, n, n, False))
    part = x.reshape(rows, LEAF, n // LEAF)
    part = _reduce(_roots(LEAF, LEAF, LEAF, False) @ part)
    part *= _roots(LEAF, n // LEAF, n, False)
    return transform(_reduce(part).reshape(rows * LEAF, n // LEAF)).reshape(rows, n)


def inverse(x: np.ndarray) -> np.ndarray:
    """Rows from their transforms, times their length."""
    rows, n = x.shape
    if n <= LEAF:
        return _reduce(x @ _roots(n, n, n, True))
    part = inverse(x.reshape(rows * LEAF, n // LEAF)).reshape(rows, LEAF, n // LEAF)
    part *= _roots(LEAF, n // LEAF, n, True)
    return _reduce(_roots(LEAF, LEAF, LEAF, True) @ _reduce(part)).reshape(rows, n)


def _square_sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values.astype(np.int64) ** 2 % PRIME)))


def zero_seeds(words: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and distances from scale to under 2 * scale whose squared differences are zero.

    Blocks begin at the multiples of the scale; distances ascend within a block.
    """
    block = min(scale, BLOCK)
    count = (len(words) - block) // scale + 1 if len(words) >= block + scale else 0
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    residues = words % PRIME
    padded = np.concatenate((residues, np.zeros(3 * scale + block, residues.dtype)))
    sums = _square_sums(padded)
    values = padded.astype(np.float64)
    unit = pow(2 * block, -1, PRIME)
    found_blocks, found_distances = [], []
    many = max(TILE // (2 * block), 1)
    lags = np.arange(block)
    for first in range(0, count, many):
        starts = np.arange(first, min(first + many, count)) * scale
        own = np.zeros((len(starts), 2 * block))
        own[:, :block] = values[starts[:, None] + lags[::-1]]
        own = transform(own)
        squares = sums[starts + block] - sums[starts]
        for chunk in range(0, scale, block):
            begins = starts + scale + chunk
            later = transform(values[begins[:, None] + np.arange(2 * block)])
            later *= own
            both = inverse(_reduce(later))[:, block - 1 : 2 * block - 1].astype(np.int64)
            copies = begins[:, None] + lags
            there = sums[copies + block] - sums[copies]
            left = (squares[:, None] + there - 2 * (both % PRIME * unit)) % PRIME
            row, lag = np.nonzero(left == 0)
            found_blocks.append(row + first)
            found_distances.append(lag + scale + chunk)
    blocks, distances = np.concatenate(found_blocks), np.concatenate(found_distances)
    # distances lie within twice the scale, so the pairs are numbered by them
    order = np.argsort(blocks * (2 * scale) + distances)
    return blocks[order], distances[order]


def _equal_ahead(words: np.ndarray, a: int, b: int) -> int:
    """How many words from a on equal those from b on, a < b."""
    done, step = 0, 64
    while b + done < len(words):
        stop = min(step, len(words) - b - done)
        differ = words[a + done : a + done + stop] != words[b + done : b + done + stop]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + stop, 2 * step
    return done


def _equal_behind(words: np.ndarray, a: int, b: int) -> int:
    """How many words before a equal those before b, a < b."""
    done, step = 0, 64
    while a - done > 0:
        stop = min(step, a - done)
        differ = (words[a - done - stop : a - done] != words[b - done - stop : b - done])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + stop, 2 * step
    return done


def _streaks(words: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, first and last block of every row of two or more zero blocks, by distance."""
    blocks, distances = zero_seeds(words, scale)
    last = int(blocks[-1]) + 2 if len(blocks) else 1
    keys = np.sort(distances * last + blocks)
    breaks = np.flatnonzero(np.diff(keys) != 1) + 1
    heads, tails = keys[np.r_[0, breaks]] if len(keys) else keys, keys[np.r_[breaks - 1, -1]] if len(keys) else keys
    rows = tails > heads
    heads, tails = heads[rows], tails[rows]
    return heads // last, heads % last, tails % last


def find_runs(words: np.ndarray, lengths: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers.

    ``lengths`` names the stretches of ``words``, in ascending order, that no run crosses; periods of a
    quarter of a stretch at most are looked for in it.
    """
    lengths = np.array([len(words)]) if lengths is None else lengths
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    scale = 1
    while len(lengths) and TIMES * scale <= lengths[-1]:
        base = int(starts[np.searchsorted(lengths, TIMES * scale)])
        part = words[base:]
        block = min(scale, BLOCK)
        distances, heads, tails = _streaks(part, scale)
        live = np.ones(len(distances), bool)
        if len(live):
            at = heads * scale + base
            order = np.argsort(at, kind="stable")
            for start, length, period in found:
                if length >= block + scale:
                    low, high = np.searchsorted(at[order], (start, start + length))
                    own = order[low:high]
                    inside = at[own] + block + distances[own] <= start + length
                    live[own[inside & (distances[own] % period == 0)]] = False
        fresh = []
        for d, head, tail in zip(distances[live].tolist(), heads[live].tolist(), tails[live].tolist()):
            while head <= tail:
                x = head * scale
                ahead = _equal_ahead(part, x, x + d)
                if ahead < block:
                    head += 1
                    continue
                start = x - _equal_behind(part, x, x + d)
                end = x + d + ahead
                if end - start >= max(LEAST, TIMES * d) and (start + base, end + base) not in known:
                    known.add((start + base, end + base))
                    fresh.append((start + base, end - start, d))
                head = (x + ahead - block) // scale + 1
        found += fresh
        scale *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of every list of words; short lists are searched together."""
    numbers: dict[bytes, int] = {}
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    order = [i for i in order if len(texts[i]) >= LEAST]
    stretches, lengths = [], []
    for i in order:
        own = [numbers.setdefault(w, len(numbers) + 1) for w in texts[i]]
        stretches.append(np.array([*own, 0], np.int64))
        lengths.append(len(own) + 1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not order:
        return out
    words = np.concatenate(stretches)
    ends = np.cumsum(lengths)
    # a word of its own after every text, which no run crosses
    words[ends - 1] = len(numbers) + 1 + np.arange(len(order))
    begins = ends - np.array(lengths)
    for start, length, period in find_runs(words, np.array(lengths)):
        k = int(np.searchsorted(ends, start, side="right"))
        out[order[k]].append((start - int(begins[k]), length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    return b" ".join(words)


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by ``runs`` (start, length, period) and ``collapsed``, the text without repeats."""
    rest = [c for c in docs.columns if c not in ("runs", "collapsed", text)]
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*rest).schema)
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, left = [], []
        texts = text_bytes(batch.column(len(rest)))
        for a, b in slices(texts):
            words = [t.split() for t in texts[a:b]]
            runs = runs_of_texts(words)
            found += [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
            left += [collapse(w, r).decode() for w, r in zip(words, runs)]
        columns = [*batch.columns[:-1], pa.array(found, kind), pa.array(left, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*rest, "runs", "collapsed"])

    return map_arrow(docs.select(*rest, text), run, f"{types}runs {RUN}, collapsed string")


def planted_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, or for one document in ten, told by its id, with a periodic end; not for a null id."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % period] for i in range(a, n)]


def plant_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the planted words of every text, joined by spaces."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)))
        made = [b" ".join(planted_words(i, t.split())).decode() for i, t in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(made, pa.string())], names=["doc_id", "text"]
        )

    kept = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(kept, run, "doc_id long, text string")


def run_report(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of every document with planted repeats."""
    found = collapse_runs(plant_repeats(docs))
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.expr("best.length * 1000 div -best.col3").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
