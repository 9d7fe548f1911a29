"""Online training: a network kept up to date by a stream of rows and targets.

The state is the triangular factor of all rows seen, at most nodes + 1 rows of
nodes + 1 numbers.  A micro-batch is reduced by the batch solver and stacked on
it, so the online model equals a batch fit of the same rows, in any order and
any division into micro-batches; there is no late data.

State is written per stream and batch id and built from the newest earlier one.
When a batch is repeated after a failure it starts from the same earlier state
and replaces its own, so no row counts twice; older states than the last two
are removed.  A stream is known by its checkpoint: starting again with the same
checkpoint continues it, another checkpoint on a state that has rows is refused
unless ``after`` says that it adds to them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sensorlab.operators.elm.layer import Layer
from sensorlab.operators.elm.model import ElmClassificationModel, ElmRegressionModel
from sensorlab.operators.elm.solver import RCOND, design_rows, fold, gather, solve

STATE = "position int, row array<double>, run string, batch bigint"
#: States that are kept: the newest, and the one a repeated batch starts from.
KEPT = 2


class OnlineElm:
    """Trains one hidden layer's output weights from micro-batches."""

    def __init__(
        self,
        spark: SparkSession,
        layer: Layer,
        state_path: str,
        features: str = "features",
        target: str = "binaryLabel",
        rcond: float = RCOND,
    ):
        self.spark = spark
        self.layer = layer
        self.state_path = state_path
        self.features = features
        self.target = target
        self.rcond = rcond
        # name of the stream, and the state that it starts from
        self._run = "direct"
        self._base: np.ndarray | None = None
        # the last states by batch id, so that storage is read on restart only
        self._recent: dict[int, np.ndarray] = {}

    def _states(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(STATE).parquet(self.state_path)
        except AnalysisException:
            return None

    def _stored(self, run: str, before: int | None = None) -> np.ndarray | None:
        """Newest factor of a stream, or the newest one older than a batch."""
        states = self._states()
        if states is None:
            return None
        states = states.where(F.col("run") == run)
        if before is not None:
            states = states.where(F.col("batch") < before)
        newest = states.agg(F.max("batch")).first()[0]
        if newest is None:
            return None
        rows = states.where(F.col("batch") == newest).orderBy("position").collect()
        return np.array([r["row"] for r in rows])

    def _state(self, before: int | None = None) -> np.ndarray | None:
        known = [b for b in self._recent if before is None or b < before]
        if known:
            return self._recent[max(known)]
        stored = self._stored(self._run, before)
        return self._base if stored is None else stored

    def _path(self, batch_id: int) -> str:
        return f"{self.state_path}/run={self._run}/batch={batch_id}"

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Add one micro-batch; calling it again for the same id changes nothing."""
        layer = self.layer
        rows = design_rows(batch, lambda x: [layer.outputs(x)], self.features, self.target)
        factors = gather(rows, layer.nodes + 1, empty_ok=True)
        factor = self._state(before=batch_id)
        if factors:
            factor = fold(factor, factors[0])
        if factor is None:
            return
        table = self.spark.createDataFrame(
            [(i, row.tolist()) for i, row in enumerate(factor)], "position int, row array<double>"
        )
        table.coalesce(1).write.mode("overwrite").parquet(self._path(batch_id))
        self._recent = {b: f for b, f in self._recent.items() if b < batch_id}
        self._recent[batch_id] = factor
        while len(self._recent) > KEPT:
            oldest = min(self._recent)
            del self._recent[oldest]
            self._remove(oldest)
        self._remove(batch_id - KEPT)

    def _remove(self, batch_id: int) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(batch_id))
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def _begin(self, checkpoint: str, after: str | None) -> None:
        run = hashlib.md5(checkpoint.encode()).hexdigest()[:16]
        states = self._states()
        known = [] if states is None else [r["run"] for r in states.select("run").distinct().collect()]
        if run not in known and known and after is None:
            raise ValueError(
                f"{self.state_path} has the state of another stream; name its checkpoint in "
                "`after` to add to it, or use another path"
            )
        if after is not None:
            self._base = self._stored(hashlib.md5(after.encode()).hexdigest()[:16])
            if self._base is None:
                raise ValueError(f"no state of a stream with the checkpoint {after}")
        self._run, self._recent = run, {}

    def start(
        self,
        stream: DataFrame,
        checkpoint: str,
        after: str | None = None,
        trigger: dict | None = None,
    ) -> StreamingQuery:
        """Train on all files the stream has now, then stop; or as ``trigger`` says,
        for example ``{"processingTime": "1 minute"}``.

        ``after`` is the checkpoint of an earlier stream whose state this one adds to.
        """
        self._begin(checkpoint, after)
        return (
            stream.select(self.features, self.target)
            .writeStream.foreachBatch(self.update)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def model(
        self, regression: bool = False, nodes: int | None = None
    ) -> ElmClassificationModel | ElmRegressionModel:
        """Network from the newest state, as a classifier or as a regression; with ``nodes`` the
        network of the layer's first nodes alone, as if it had been trained by itself."""
        factor = self._state()
        if factor is None:
            raise ValueError("no rows seen yet")
        kind = ElmRegressionModel if regression else ElmClassificationModel
        layer = self.layer if nodes is None else self.layer.first(nodes)
        model = kind(layer, solve(factor, layer.nodes, rcond=self.rcond))
        model._set(
            activationFunc=layer.activation,
            hiddenNodes=layer.nodes,
            rcond=self.rcond,
            featuresCol=self.features,
            labelCol=self.target,
        )
        return model
