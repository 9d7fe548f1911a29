"""Metrics of predictions and scores, each from one aggregate where it can be.

One rule for all: a null score, prediction or label fails the job, as an empty
table does. Rows are never left out of a metric.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlab.functions.labels import above, squared_difference
from sensorlab.session import kept

# The twenty thresholds 0.05, 0.10, .. 1.00.
SWEEP_STEP = 0.05
SWEEP_COUNT = 20


def present(column: str | Column, what: str) -> Column:
    """The column as a double; a null fails the job."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    problem = F.raise_error(F.lit(f"null {what} among the rows"))
    return F.coalesce(value, problem.cast("double"))


def error_metrics(
    df: DataFrame, prediction: str = "prediction", label: str = "binaryLabel"
) -> DataFrame:
    """Total squared difference, row count and their ratio; an empty table fails."""
    gap = present(squared_difference(prediction, label), "prediction or label")
    return df.agg(F.sum(gap).alias("total"), F.count("*").alias("rows")).select(
        F.when(F.col("rows") == 0, F.raise_error(F.lit("no rows to evaluate")).cast("double"))
        .otherwise(F.col("total"))
        .alias("total"),
        "rows",
        F.try_divide("total", "rows").alias("misclassification"),
    )


def error_metrics_of(
    df: DataFrame, predictions: Sequence[str], label: str = "binaryLabel"
) -> DataFrame:
    """:func:`error_metrics` of several predictions side by side, a row each in their order, from one scan."""
    gaps = [present(squared_difference(p, label), "prediction or label") for p in predictions]
    sums = df.agg(F.count("*").alias("rows"), *[F.sum(gap).alias(f"total_{i}") for i, gap in enumerate(gaps)])
    rows = F.when(F.col("rows") == 0, F.raise_error(F.lit("no rows to evaluate")).cast("bigint")).otherwise(F.col("rows"))
    cells = [
        F.struct(F.lit(p).alias("prediction"), F.col(f"total_{i}").alias("total"), rows.alias("rows"))
        for i, p in enumerate(predictions)
    ]
    return sums.select(F.inline(F.array(*cells))).withColumn("misclassification", F.col("total") / F.col("rows"))


def error_breakdown(
    df: DataFrame, prediction: str = "prediction", label: str = "binaryLabel"
) -> DataFrame:
    """Rows and summed difference per distinct squared difference."""
    gap = present(squared_difference(prediction, label), "prediction or label")
    rows = df.select(gap.alias("squared_diff"))
    return rows.groupBy("squared_diff").agg(
        F.sum("squared_diff").alias("total"), F.count("*").alias("rows")
    )


def confusion_counts(
    df: DataFrame, prediction: str = "prediction", label: str = "binaryLabel"
) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = df.select(
        present(label, "label").cast(kinds[label]).alias(label),
        present(prediction, "prediction").cast(kinds[prediction]).alias(prediction),
    )
    return rows.groupBy(label, prediction).agg(F.count("*").alias("count"))


def sweep_thresholds() -> list[float]:
    return [SWEEP_STEP * i for i in range(1, SWEEP_COUNT + 1)]


def threshold_sweep(
    df: DataFrame, score: str, label: str, thresholds: Sequence[float] | None = None
) -> DataFrame:
    """Error and accuracy of ``score > threshold`` for each threshold.

    All thresholds are counted side by side in one aggregate; the rows of the
    table are never multiplied by the number of thresholds.
    """
    thresholds = sweep_thresholds() if thresholds is None else list(thresholds)
    wrong = [
        F.sum((above("score", cut) != F.col("label")).cast("bigint")).alias(f"wrong_{i}")
        for i, cut in enumerate(thresholds)
    ]
    rows = df.select(present(score, "score").alias("score"), present(label, "label").alias("label"))
    counted = rows.agg(F.count("*").alias("rows"), *wrong)
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(cut).alias("threshold"),
                (F.col(f"wrong_{i}") / F.col("rows")).alias("error"),
            )
            for i, cut in enumerate(thresholds)
        ]
    )
    return counted.select(F.inline(rows)).withColumn("accuracy", 1 - F.col("error"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep row of least error, the first of equals."""
    return sweep.orderBy("error", "step").limit(1)


def score_column(df: DataFrame, score: str) -> Column:
    """A numeric score, or the second element of a raw prediction vector; never null."""
    if isinstance(df.schema[score].dataType, VectorUDT):
        return present(vector_to_array(F.col(score))[1], "score")
    return present(score, "score")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positives and negatives of every distinct score of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        # adding zero makes one score of both zeros
        scores, place = np.unique(batch.column(0).to_numpy() + 0.0, return_inverse=True)
        positive = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        positives = np.bincount(place, positive, len(scores)).astype(np.int64)
        counts = np.bincount(place, minlength=len(scores))
        yield pa.RecordBatch.from_arrays(
            [pa.array(scores), pa.array(positives), pa.array(counts - positives)],
            names=["score", "positives", "negatives"],
        )


def _groups(segments: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Starts of the rows of one segment and one score, NaN equal to NaN."""
    odd = np.isnan(scores)
    same = (scores[1:] == scores[:-1]) | (odd[1:] & odd[:-1])
    return np.flatnonzero(np.r_[True, (segments[1:] != segments[:-1]) | ~same])


def _counted(scores: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct scores in order, NaN last, and the sums of their counts."""
    order = np.argsort(scores)
    scores = scores[order]
    starts = _groups(np.zeros(len(scores)), scores)
    return [scores[starts], *(np.add.reduceat(c[order].astype(np.int64), starts) for c in counts)]


class _Ranking:
    """Positives, negatives, and pairs in which the positive has the higher score,
    ties counting half, over rows in the order of their scores."""

    def __init__(self):
        self.first: float | None = None
        self.positives = self.negatives = 0
        self.pairs = 0.0
        # rows of the greatest score so far, which further rows may share
        self.last, self.last_positives, self.last_negatives = 0.0, 0, 0

    def add(self, scores: np.ndarray, positives: np.ndarray, negatives: np.ndarray) -> None:
        if self.first is None:
            self.first = float(scores[0])
        else:
            scores = np.r_[self.last, scores]
            positives = np.r_[self.last_positives, positives]
            negatives = np.r_[self.last_negatives, negatives]
        scores, p, n = _counted(scores, positives, negatives)
        self._count(p[:-1], n[:-1])
        self.last, self.last_positives, self.last_negatives = scores[-1], int(p[-1]), int(n[-1])

    def _count(self, p: np.ndarray, n: np.ndarray) -> None:
        below = self.negatives + np.cumsum(n) - n
        self.pairs += float(p @ (below + 0.5 * n))
        self.positives += int(p.sum())
        self.negatives += int(n.sum())

    def settle(self) -> None:
        self._count(np.array([self.last_positives * 1.0]), np.array([self.last_negatives * 1.0]))


def _ranked_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a range of scores: its first score and its ranking."""
    ranking = _Ranking()
    for batch in batches:
        if batch.num_rows:
            ranking.add(*(batch.column(i).to_numpy() for i in range(3)))
    if ranking.first is not None:
        ranking.settle()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ranking.first]),
                pa.array([ranking.positives], pa.int64()),
                pa.array([ranking.negatives], pa.int64()),
                pa.array([ranking.pairs]),
            ],
            names=["first", "positives", "negatives", "pairs"],
        )


#: Scores that a task packs at once, those that a range should have, and those that one value of a sample stands for.
BLOCK_SCORES, RANGE_SCORES, SAMPLED_SCORES = 1_000_000, 1_000_000, 16_384
BLOCKS = "segment long, size long, sample array<double>, scores binary, positives binary, negatives binary"
SLICES = "range long, segment long, scores binary, positives binary, negatives binary"
RANKED = "segment long, first double, positives long, negatives long, pairs double"


def _bytes(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest one needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _unpacked(scores: bytes, *counts: bytes) -> list[np.ndarray]:
    values = np.frombuffer(scores, np.float64)
    return [values, *(np.frombuffer(c, f"u{len(c) // len(values)}") for c in counts)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct scores of a segment with their counts, and a sample of them, a row for many scores."""
    held: dict[int, list[tuple]] = {}
    size = 0

    def packed() -> pa.RecordBatch:
        rows = []
        for segment, parts in held.items():
            scores, p, n = _counted(*(np.concatenate(c) for c in zip(*parts)))
            sample = scores[SAMPLED_SCORES // 2 :: SAMPLED_SCORES] if len(scores) > SAMPLED_SCORES else scores[len(scores) // 2 :][:1]
            rows.append((segment, len(scores), sample, scores.tobytes(), _bytes(p), _bytes(n)))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), *[pa.binary()] * 3)
        names = [part.split()[0] for part in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        segments, scores, *counts = (batch.column(i).to_numpy() for i in range(4))
        # adding zero makes one score of both zeros
        columns = (scores + 0.0, *counts)
        if np.count_nonzero(segments[1:] != segments[:-1]) > 100:
            order = np.argsort(segments, kind="stable")
            segments, columns = segments[order], tuple(c[order] for c in columns)
        starts = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]]).tolist()
        for a, b in zip(starts, [*starts[1:], len(segments)]):
            held.setdefault(int(segments[a]), []).append(tuple(c[a:b] for c in columns))
        size += len(segments)
        if size >= BLOCK_SCORES:
            yield packed()
            held, size = {}, 0
    if held:
        yield packed()


def _cuts(sketch: list) -> dict[int, tuple[int, np.ndarray]]:
    """Number of each segment's first range and the scores at which its further ranges begin."""
    parts: dict[int, list] = {}
    for segment, size, sample in sketch:
        parts.setdefault(segment, []).append((size, np.array(sample, float)))
    found, ranges = {}, 0
    for segment, own in sorted(parts.items()):
        values = np.concatenate([v for _, v in own])
        weights = np.concatenate([np.full(len(v), size / len(v)) for size, v in own])
        order = np.argsort(values)
        values, below = values[order], np.cumsum(weights[order])
        wanted = np.arange(1, -(-below[-1] // RANGE_SCORES)) * RANGE_SCORES
        cuts = np.unique(values[np.searchsorted(below, wanted)])
        cuts = cuts[~np.isnan(cuts)]
        found[segment] = ranges, cuts
        ranges += len(cuts) + 1
    return found


def _slices(cuts: dict[int, tuple[int, np.ndarray]]):
    """Blocks cut at the ranges of their segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SLICES.split(", ")]
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 3)
        for batch in batches:
            for i in range(batch.num_rows):
                segment, *parts = (batch.column(c)[i].as_py() for c in range(4))
                first, own = cuts[segment]
                scores, p, n = _unpacked(*parts)
                edges = [0, *np.searchsorted(scores, own, "left").tolist(), len(scores)]
                rows = [
                    (first + r, segment, *(c[a:b].tobytes() for c in (scores, p, n)))
                    for r, (a, b) in enumerate(zip(edges, edges[1:]))
                    if a < b
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names
                )

    return run


def _ranked_range(table: pa.Table) -> pa.Table:
    """One row for a range of a segment: its first score there and its ranking."""
    slices = [_unpacked(*row.values()) for row in table.select(["scores", "positives", "negatives"]).to_pylist()]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c)) for c in zip(*slices)], names=["score", "positives", "negatives"]
    )
    (ranked,) = _ranked_pairs(iter([batch]))
    return pa.table({"segment": table.column("segment").slice(0, 1)} | ranked.to_pydict())


def _ranked_ranges(counted: DataFrame) -> list:
    """Rows ``RANKED`` of the ranges of rows (segment, score, positives, negatives); scores may repeat.

    Scores are packed into blocks where they are made, and only the blocks are kept and moved: a
    range's scores meet as a few arrays, not as rows. Every range of a segment has about
    RANGE_SCORES scores, by a sample of the blocks, which weighs on their sizes only.
    """
    with kept(counted.mapInArrow(_blocks, BLOCKS)) as blocks:
        cuts = _cuts(blocks.select("segment", "size", "sample").collect())
        slices = blocks.select("segment", "scores", "positives", "negatives").mapInArrow(_slices(cuts), SLICES)
        return slices.groupBy("range").applyInArrow(_ranked_range, RANKED).collect()


def area_under_roc(df: DataFrame, score: str = "rawPrediction", label: str = "binaryLabel") -> float:
    """Exact area under the ROC curve.

    It is the share of (positive, negative) pairs that the score puts in order,
    ties counting half.  Tasks first pack their scores into blocks of sorted, counted
    values, so one score of very many rows is few; then the blocks' slices are dealt by
    ranges, and each range returns its totals in one row.  Equal scores share a range;
    pairs across ranges follow from the totals.
    """
    positive = (present(label, "label") > 0.5).cast("bigint")
    counted = df.select(
        F.lit(0).cast("bigint").alias("segment"),
        score_column(df, score).alias("score"),
        positive.alias("positives"),
        (1 - positive).alias("negatives"),
    )
    parts = _ranked_ranges(counted)
    if not parts:
        raise ValueError("no rows to evaluate")
    return _areas(parts)[0][1]


def _areas(parts: list) -> list[tuple[int, float, int]]:
    """(segment, area, rows) of every segment from the rows of its ranges, in the order of their scores."""
    found: dict[int, list] = {}
    # a range of nothing but NaN is the last, as in Spark's order
    for segment, first, positives, below, pairs in sorted(parts, key=lambda r: (r[0], r[1] != r[1], r[1])):
        p, n, ordered = found.get(segment, (0, 0, 0.0))
        found[segment] = p + positives, n + below, ordered + pairs + float(positives) * n
    # one class only: what a curve through (1, 1) gives
    return [
        (segment, ordered / (float(p) * n) if p and n else float(p > 0), p + n)
        for segment, (p, n, ordered) in found.items()
    ]


def area_under_roc_by(
    df: DataFrame, segment: str, score: str = "rawPrediction", label: str = "binaryLabel"
) -> DataFrame:
    """(segment, area, rows): exact area under the ROC curve of every segment, in one ranking.

    Equal scores of a segment are counted first, in an aggregate that combines before it moves, so
    the rows are read once: the ranging samples what the aggregate left. A segment of one class
    has area 1 if that is the positive one, else 0; a null segment fails the job.
    """
    key = present(segment, "segment").cast("bigint")
    rows = df.select(
        key.alias("segment"),
        score_column(df, score).alias("score"),
        (present(label, "label") > 0.5).alias("positive"),
    )
    found = areas_of_counts(
        rows.groupBy("segment", "score").agg(
            F.count_if("positive").alias("positives"), F.count_if(~F.col("positive")).alias("negatives")
        )
    )
    return df.sparkSession.createDataFrame(found, "segment long, area double, rows long")


def areas_of_counts(counted: DataFrame) -> list[tuple[int, float, int]]:
    """(segment, area, rows) of rows (segment, score, positives, negatives); scores may repeat.

    All segments share one exchange by ranges of their scores, so a segment of any size is spread
    over as many ranges as it needs. Each range leaves one row, and pairs across ranges follow
    from running totals over those.
    """
    return _areas(_ranked_ranges(counted))


def _precision_steps(before: dict[int, tuple[int, int]], all_positives: int):
    """Per range, the area between its points of the curve, from the counts before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        areas: dict[int, float] = {}
        at, held = None, None
        tp = fp = 0
        precision = None

        def add(p: np.ndarray, n: np.ndarray) -> None:
            nonlocal tp, fp, precision
            if not len(p):
                return
            true, false = tp + np.cumsum(p), fp + np.cumsum(n)
            points = true / (true + false)
            first = points[0] if precision is None else precision
            steps = p * (np.r_[first, points[:-1]] + points) / 2
            areas[at] = areas.get(at, 0.0) + float(steps.sum())
            tp, fp, precision = int(true[-1]), int(false[-1]), float(points[-1])

        def settled() -> None:
            if held is not None:
                add(np.array([held[1]]), np.array([held[2]]))

        for batch in batches:
            if not batch.num_rows:
                continue
            ranges, scores, p, n = (batch.column(i).to_numpy() for i in range(4))
            edges = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(ranges)]):
                if ranges[a] != at:
                    settled()
                    at, held = int(ranges[a]), None
                    tp, fp = before[at]
                    precision = tp / (tp + fp) if tp + fp else None
                own, own_p, own_n = scores[a:b], p[a:b], n[a:b]
                if held is not None:
                    own, own_p, own_n = np.r_[held[0], own], np.r_[held[1], own_p], np.r_[held[2], own_n]
                starts = _groups(np.zeros(len(own)), own)
                own_p, own_n = np.add.reduceat(own_p, starts), np.add.reduceat(own_n, starts)
                add(own_p[:-1], own_n[:-1])
                # rows of the last score, which further rows may share
                held = own[-1], int(own_p[-1]), int(own_n[-1])
        settled()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(areas), pa.int32()), pa.array([a / all_positives for a in areas.values()], pa.float64())],
            names=["range", "area"],
        )

    return run


def area_under_pr(df: DataFrame, score: str = "rawPrediction", label: str = "binaryLabel") -> float:
    """Exact area under the precision-recall curve, its points joined by straight lines.

    The curve begins at recall 0 with the precision of the highest score. Precision
    at a score depends on all rows above it: rows are ranged by score once and kept, the ranges'
    counts (one row each) give what lies above every range, and each range then adds
    its own steps. Without positives the area is 0.
    """
    positive = present(label, "label") > 0.5
    counted = df.select(
        score_column(df, score).alias("score"), positive.alias("positive")
    ).mapInArrow(_combined, "score double, positives long, negatives long")
    ranged = (
        counted.repartitionByRange(F.desc("score"))
        .sortWithinPartitions(F.desc("score"))
        .select(F.spark_partition_id().alias("range"), "score", "positives", "negatives")
    )
    with kept(ranged):
        totals = ranged.groupBy("range").agg(F.sum("positives"), F.sum("negatives")).collect()
        if not totals:
            raise ValueError("no rows to evaluate")
        before, p, n = {}, 0, 0
        for part, positives, negatives in sorted(map(tuple, totals)):
            before[part] = (p, n)
            p, n = p + positives, n + negatives
        if not p:
            return 0.0
        steps = ranged.mapInArrow(_precision_steps(before, p), "range int, area double")
        return float(sum(row["area"] for row in sorted(steps.collect())))


def area_under(
    df: DataFrame,
    score: str = "rawPrediction",
    label: str = "binaryLabel",
    metric: str = "areaUnderROC",
    bins: int = 0,
) -> float:
    """Area under the ROC or precision-recall curve.

    ``bins=0`` is exact.  With more, Spark merges neighbouring points of the
    curve, which is enough for very many distinct scores.
    """
    if bins == 0:
        return {"areaUnderROC": area_under_roc, "areaUnderPR": area_under_pr}[metric](df, score, label)
    rows = df.select(score_column(df, score).alias("score"), present(label, "label").alias("label"))
    return BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="label", metricName=metric, numBins=bins
    ).evaluate(rows)


class AreaUnderRocEvaluator(
    Evaluator, HasRawPredictionCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable
):
    """:func:`area_under_roc` for cross-validators; larger is better."""

    @keyword_only
    def __init__(self, *, rawPredictionCol="rawPrediction", labelCol="binaryLabel"):
        super().__init__()
        self._setDefault(rawPredictionCol="rawPrediction", labelCol="binaryLabel")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        return area_under_roc(
            dataset,
            self.getOrDefault(self.rawPredictionCol),
            self.getOrDefault(self.labelCol),
        )


class MisclassificationEvaluator(
    Evaluator, HasPredictionCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Mean squared difference of prediction and 0/1 label; smaller is better."""

    @keyword_only
    def __init__(self, *, predictionCol="prediction", labelCol="binaryLabel"):
        super().__init__()
        self._setDefault(predictionCol="prediction", labelCol="binaryLabel")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        row = error_metrics(
            dataset,
            self.getOrDefault(self.predictionCol),
            self.getOrDefault(self.labelCol),
        ).first()
        return row["misclassification"]

    def isLargerBetter(self) -> bool:
        return False
