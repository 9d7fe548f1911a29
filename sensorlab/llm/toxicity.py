"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its words, A-Z lower-cased, and the first four and five bytes
of longer words; a term is present or not. Terms are hashed to 2^22 places. From
a sample of labelled documents the ``TERMS`` places are kept whose presence tells
most about the label: they stand in ``LEAST_ROWS`` documents or more, and their
likelihood-ratio statistic is at least ``LEAST_G``, which a term that has nothing
to do with the label reaches once in 40 times. Places that tell nothing by themselves are kept where
they tell in pairs: of the ``PAIR_PLACES`` places whose presence varies most, every two are
counted together in the sample, and both stay if what the pair tells beyond its two places reaches
``LEAST_PAIR_G``, which one pair in five million does by chance. A factorization
machine then learns a weight for every place and, by the product of two factor
vectors, one for every pair of places that stand in one text, such as an insult
beside the mention of a group.

The sample is at most about ``SAMPLE_ROWS`` labelled rows, taken by hash. Its
places and weights are a few hundred kB, whatever the corpus. Whole texts are
scored.

Null and empty texts have no terms: their score is that of the bias. Rows with a
null id are not held out and have no label. Where fewer than two labels are left
the score is the share of label 1, or 0.5. Repeated rows get equal scores; an
empty table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import slices, small_batches, text_bytes, word_hashes
from sensorlab.llm.rule_ensemble import learned_from, remainder

SAMPLE_ROWS = 20_000
PLACES = 1 << 22
TERMS, LEAST_ROWS, LEAST_G = 2048, 4, 5.0
PAIR_PLACES, PAIRS, LEAST_PAIR_G = 1024, 256, 28.0
FACTORS, ROUNDS, STEP, SEED = 4, 120, 0.05, 37
#: Lengths in bytes of the word beginnings that are terms.
HEADS = (4, 5)


def text_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all terms of all texts, and the text each belongs to; once per text."""
    kinds = []
    for head in (None, *HEADS):
        hashes, counts = word_hashes(texts, head)
        owner = np.repeat(np.arange(len(texts)), counts)
        kinds.append((owner << 22) | (hashes % np.uint64(PLACES)).astype(np.int64))
    both = np.unique(np.concatenate(kinds))
    return both & (PLACES - 1), both >> 22


class Machine:
    """A fitted machine: places, and for each its weight and factors."""

    def __init__(self, bias: float, places: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        order = np.argsort(places)
        self.bias, self.places = bias, places[order]
        self.weights, self.factors = weights[order], factors[order]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.places):
            terms, owner = text_terms(texts)
            at = np.searchsorted(self.places, terms).clip(0, len(self.places) - 1)
            hit = self.places[at] == terms
            at, owner = at[hit], owner[hit]
            total += np.bincount(owner, self.weights[at], len(texts))
            for factor in self.factors.T:
                own = factor[at]
                sums = np.bincount(owner, own, len(texts))
                total += 0.5 * (sums**2 - np.bincount(owner, own**2, len(texts)))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts = text_bytes(batch.column(1))
        for a, b in slices(texts):
            terms, owner = text_terms(texts[a:b])
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(b - a + 1)), pa.int32()), pa.array(terms)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), lists], names=["label", "terms"]
            )


def telling_places(rows: DataFrame) -> np.ndarray:
    """TERMS places by mutual information of presence and label."""
    totals = rows.agg(F.count("*"), F.sum("label")).first()
    n, ones = totals[0], totals[1]
    counts = (
        rows.select("label", F.explode("terms").alias("place"))
        .groupBy("place")
        .agg(F.count("*").alias("held"), F.sum("label").alias("held_ones"))
        .where(F.col("held") >= LEAST_ROWS)
    )

    def part(both, first, second):
        share = F.when(both > 0, both / n).otherwise(F.lit(0.0))
        return share * F.log(F.greatest(both * n / (first * second), F.lit(1e-300)))

    a, b = F.col("held_ones").cast("double"), F.col("held").cast("double")
    told = (
        part(a, b, F.lit(ones))
        + part(b - a, b, F.lit(n - ones))
        + part(F.lit(ones) - a, F.lit(n) - b, F.lit(ones))
        + part(F.lit(n - ones) - b + a, F.lit(n) - b, F.lit(n - ones))
    )
    kept = counts.where((b < n) & (2 * n * told >= LEAST_G))
    best = kept.orderBy(F.desc(told), "place").limit(TERMS).select("place").collect()
    return np.array(sorted(r["place"] for r in best), np.int64)


def _both(places: np.ndarray):
    """Rows of each label that hold each two of the places, as one matrix per task and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, len(places), len(places)), np.float32)
        for batch in small_batches(batches):
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            lists = batch.column("terms")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            terms = lists.flatten().to_numpy()
            at = np.searchsorted(places, terms).clip(0, len(places) - 1)
            hit = places[at] == terms
            own = np.zeros((len(lists), len(places)), np.float32)
            own[owner[hit], at[hit]] = 1
            for label in (0, 1):
                part = own[labels == label]
                held[label] += part.T @ part
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int32()), pa.array([h.tobytes() for h in held], pa.binary())],
            names=["label", "held"],
        )

    return run


def pair_gains(held: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """Likelihood-ratio statistic of every pair of places beyond its two places.

    ``held[l, i, j]`` are rows of label l with both. Labels are compared over the four
    cases of a pair, less what either place tells alone.
    """
    sizes = np.array([zeros, ones], float)

    def told(cells: list[np.ndarray]) -> np.ndarray:
        """G of a table of cases by label; ``cells`` are counts with the labels first."""
        out = np.zeros(cells[0].shape[1:])
        n = sizes.sum()
        for cell in cells:
            both = cell.sum(axis=0)
            for label in (0, 1):
                share = both * sizes[label] / n
                own = cell[label]
                out += np.where(own > 0, 2 * own * np.log(np.maximum(own, 1e-300) / np.maximum(share, 1e-300)), 0)
        return out

    alone = np.einsum("lii->li", held)
    a, b = alone[:, :, None], alone[:, None, :]
    whole = sizes[:, None, None]
    pair = told([held, a - held, b - held, whole - a - b + held])
    single = told([alone, sizes[:, None] - alone])
    gains = pair - single[:, None] - single[None, :]
    gains[np.tril_indices(len(gains))] = -np.inf
    return gains


def paired_places(rows: DataFrame) -> np.ndarray:
    """Places of the pairs that tell most beyond their two places; bounded by the sample."""
    totals = rows.agg(F.count("*"), F.sum("label")).first()
    n, ones = totals[0], totals[1]
    varied = (
        rows.select(F.explode("terms").alias("place"))
        .groupBy("place")
        .agg(F.count("*").alias("held"))
        .where((F.col("held") >= LEAST_ROWS) & (F.col("held") <= n - LEAST_ROWS))
        .orderBy(F.desc(F.col("held") * (n - F.col("held"))), "place")
        .limit(PAIR_PLACES)
    )
    places = np.array(sorted(r["place"] for r in varied.select("place").collect()), np.int64)
    if len(places) < 2:
        return places[:0]
    # the sample is bounded, and so is a task's pair of matrices: 8 MB
    parts = rows.coalesce(4).mapInArrow(_both(places), "label int, held binary").collect()
    held = np.zeros((2, len(places), len(places)))
    for label, counts in parts:
        held[label] += np.frombuffer(counts, np.float32).reshape(held.shape[1:])
    gains = pair_gains(held, ones, n - ones)
    best = np.argsort(-gains, axis=None, kind="stable")[:PAIRS]
    best = best[gains.ravel()[best] >= LEAST_PAIR_G]
    return np.unique(places[np.concatenate(np.unravel_index(best, gains.shape))])


def fit(labelled: DataFrame) -> Machine:
    """Fit on ``text`` and an integer ``label``."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, n = counts.get(1, 0), sum(counts.values())
    share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
    prior = float(np.log(share / (1 - share)))
    none = np.zeros(0, np.int64)
    if len(counts) < 2:
        return Machine(prior, none, np.zeros(0), np.zeros((0, FACTORS)))
    rows = labelled.select("label", "text").mapInArrow(_terms, "label int, terms array<bigint>").persist()
    try:
        places = np.union1d(telling_places(rows), paired_places(rows))
        if not len(places):
            return Machine(prior, none, np.zeros(0), np.zeros((0, FACTORS)))
        # a vocabulary of places makes sparse vectors of presence in the JVM
        vectors = CountVectorizerModel.from_vocabulary(
            [str(p) for p in places.tolist()], inputCol="places", outputCol="features", binary=True
        )
        named = rows.select("label", F.transform("terms", lambda t: t.cast("string")).alias("places"))
        table = vectors.transform(named).select("label", "features").persist()
        machine = FMClassifier(
            labelCol="label",
            factorSize=FACTORS,
            regParam=1e-5,
            initStd=0.01,
            maxIter=ROUNDS,
            stepSize=STEP,
            seed=SEED,
        ).fit(table)
        table.unpersist()
    finally:
        rows.unpersist()
    return Machine(
        float(machine.intercept), places, machine.linear.toArray(), machine.factors.toArray()
    )


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from; false for a null id."""
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    doc_id = F.col("doc_id").cast("bigint")
    texts = docs.select(
        doc_id.alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        "text",
    )
    machine = fit(learned_from(texts, labels, "toxic", SAMPLE_ROWS, held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = text_bytes(batch.column(2))
            for a, b in slices(found):
                scores = machine.scores(found[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(scores),
                        pa.array((scores >= 0.5).astype(np.int32)),
                    ],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
