"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees of a random forest are grown on labelled documents. Each path from
a root to a node is a rule, a conjunction of comparisons of statistics. A logistic
regression with an absolute penalty on its weights then chooses among the rules;
most get no weight. The chosen ones are compiled into one Spark column
expression, which scores any table that has the statistics.

The forest is fitted on at most about ``SAMPLE_ROWS`` labelled rows, taken by
hash; the statistics are worked out from whole texts of all documents.

Null and empty texts have zero statistics and get a score as all others do. Rows
with a null id have no remainder: ``held_out`` is false and no label is theirs.
Labels that are null are not learned from; where fewer than two labels are left
the score is the share of label 1, or 0.5. Repeated rows get equal scores. Columns
that clash with a statistic are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import map_arrow, written

SAMPLE_ROWS = 40_000
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.002, 31

STATISTICS = (
    "n_words",
    "word_length",
    "symbol_share",
    "separator_share",
    "exclamation_share",
    "digit_share",
    "upper_share",
    "words_per_line",
    "repeated_line_share",
    "open_line_share",
    "distinct_share",
    "stutter_share",
    "repeated_pair_share",
)

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")
_END = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")
_SYMBOLS, _SEPARATORS, _DIGITS = "#*$%&<>", "|»·•", "0123456789"


def _count(text: str, characters: str) -> int:
    return sum(text.count(c) for c in characters)


def statistics(text: str) -> tuple[float, ...]:
    """STATISTICS of a text; shares are of its words, letters or lines."""
    words = text.encode().split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    lines = [line.rstrip() for line in text.split("\n") if line.strip()]
    rows = max(len(lines), 1)
    letters = len(_LETTER.findall(text))
    pairs = set(zip(words, words[1:]))
    return (
        float(n),
        sum(map(len, words)) / n,
        _count(text, _SYMBOLS) / n,
        _count(text, _SEPARATORS) / n,
        text.count("!") / n,
        _count(text, _DIGITS) / n,
        len(_UPPER.findall(text)) / max(letters, 1),
        n / rows,
        1 - len(set(lines)) / rows,
        sum(not _END.search(line) for line in lines) / rows,
        len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - (len(pairs) + 1) / n,
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its statistics."""
    rest = [c for c in docs.columns if c not in STATISTICS and c != text]
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*rest).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([statistics(t or "") for t in batch.column(len(rest)).to_pylist()])
        columns = [*batch.columns[:-1], *(pa.array(x) for x in found.T.copy())]
        return pa.RecordBatch.from_arrays(columns, names=[*rest, *STATISTICS])

    schema = types + ", ".join(f"{name} double" for name in STATISTICS)
    return map_arrow(docs.select(*rest, text), run, schema)


Condition = tuple[int, bool, float]  # statistic, above, threshold


def tree_paths(tree) -> list[tuple[Condition, ...]]:
    """Conditions on the way to every node below the root of a fitted tree."""
    found: list[tuple[Condition, ...]] = []
    line = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")
    way: list[Condition] = []
    indents: list[int] = []
    for text in tree.toDebugString.split("\n"):
        match = line.match(text)
        if match:
            indent = len(match[1])
            while indents and indents[-1] >= indent:
                indents.pop()
                way.pop()
            indents.append(indent)
            way.append((int(match[2]), match[3] == ">", float(match[4])))
            found.append(tuple(way))
    return found


def simplified(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One bound per statistic and side."""
    bounds: dict[tuple[int, bool], float] = {}
    for statistic, above, threshold in path:
        key = (statistic, above)
        pick = max if above else min
        bounds[key] = pick(bounds[key], threshold) if key in bounds else threshold
    return tuple((s, above, t) for (s, above), t in sorted(bounds.items()))


def rule(path: tuple[Condition, ...]) -> Column:
    """A path as a boolean column."""
    out = F.lit(True)
    for statistic, above, threshold in path:
        value = F.col(STATISTICS[statistic])
        out = out & (value > F.lit(threshold) if above else value <= F.lit(threshold))
    return out


class RuleEnsemble:
    """Weighted rules; ``score`` is their logistic column."""

    def __init__(self, intercept: float, rules: list[tuple[tuple[Condition, ...], float]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for path, weight in self.rules:
            total = total + F.when(rule(path), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(labelled: DataFrame) -> RuleEnsemble:
    """Fit on STATISTICS and an integer ``label``."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, rows = counts.get(1, 0), sum(counts.values())
    if len(counts) < 2:
        share = ones / rows if rows else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return RuleEnsemble(float(np.log(share / (1 - share))), [])
    features = VectorAssembler(inputCols=list(STATISTICS), outputCol="features")
    table = features.transform(labelled).select("label", "features", *STATISTICS).persist()
    try:
        forest = RandomForestClassifier(
            labelCol="label",
            numTrees=TREES,
            maxDepth=DEPTH,
            maxBins=64,
            subsamplingRate=0.5,
            featureSubsetStrategy="onethird",
            minInstancesPerNode=5,
            seed=SEED,
        ).fit(table)
        paths = sorted({simplified(p) for tree in forest.trees for p in tree_paths(tree)})
        names = [f"rule_{i}" for i in range(len(paths))]
        marks = table.select(
            "label", *(rule(p).cast("double").alias(n) for p, n in zip(paths, names))
        )
        gathered = VectorAssembler(inputCols=names, outputCol="rules").transform(marks)
        lasso = LogisticRegression(
            featuresCol="rules",
            labelCol="label",
            elasticNetParam=1.0,
            regParam=PENALTY,
            maxIter=60,
            standardization=False,
        ).fit(gathered.select("label", "rules"))
    finally:
        table.unpersist()
    weights = lasso.coefficients.toArray().tolist()
    return RuleEnsemble(float(lasso.intercept), [(p, w) for p, w in zip(paths, weights) if w])


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor."""
    return F.crc32(doc_id.cast("string")) % divisor


def learned_from(
    scored: DataFrame, labels: DataFrame, target: str, most: int, held_out: Callable[[Column], Column]
) -> DataFrame:
    """Rows that are not held out with their label; at most about ``most``, by hash.

    Where the labels left are found to be no more than twice that, they go to the tasks, and no
    text moves.
    """
    own = labels.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(target).cast("int").alias("label")
    ).where("doc_id IS NOT NULL AND label IN (0, 1)")
    usable = own.where(~held_out(F.col("doc_id")))
    rows = max(1, usable.count())
    if rows > most:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(rows)) < most)
    usable = written(usable, "labels")
    left = usable.count()
    usable = F.broadcast(usable) if left <= 2 * most else usable.hint("merge")
    return written(scored.where("NOT held_out").drop("held_out").join(usable, "doc_id"), "labelled")


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from; false for a null id."""
    return F.coalesce(remainder(doc_id, 3) == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    doc_id = F.col("doc_id").cast("bigint")
    texts = docs.select(
        doc_id.alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        "text",
    )
    stats = written(with_statistics(texts), "statistics")
    model = fit(learned_from(stats, labels, "quality", SAMPLE_ROWS, held_out))
    score = F.col("score")
    return stats.select("doc_id", "held_out", model.score().alias("score")).withColumn(
        "predicted", (score >= 0.5).cast("int")
    )
