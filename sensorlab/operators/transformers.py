"""A label threshold as a pipeline stage."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from sensorlab.functions.labels import above
from sensorlab.schema import LABEL, require
from pyspark.sql import types as T


class ThresholdBinarizer(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """1.0 where a numeric column exceeds the threshold, else 0.0.

    The default threshold of 3 separates active codes from inactive ones but
    also puts code 0 with the latter, unlike ``binary_label``.  The output
    column must be new; it is marked as a binary attribute.
    """

    threshold = Param(
        Params._dummy(), "threshold", "values above this become 1.0", TypeConverters.toFloat
    )

    @keyword_only
    def __init__(self, *, inputCol=LABEL, outputCol="binaryLabel", threshold=3.0):
        super().__init__()
        self._setDefault(inputCol=LABEL, outputCol="binaryLabel", threshold=3.0)
        self._set(**self._input_kwargs)

    def setThreshold(self, value: float) -> ThresholdBinarizer:
        return self._set(threshold=value)

    def getThreshold(self) -> float:
        return self.getOrDefault(self.threshold)

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        require(schema, {self.getInputCol(): "numeric"})
        if self.getOutputCol() in schema.fieldNames():
            raise ValueError(f"Column {self.getOutputCol()} already exists")
        return T.StructType([*schema.fields, T.StructField(self.getOutputCol(), T.DoubleType())])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self.transformSchema(dataset.schema)
        name = self.getOutputCol()
        attribute = {"ml_attr": {"type": "binary", "name": name}}
        value = above(self.getInputCol(), self.getThreshold()).alias(name, metadata=attribute)
        return dataset.select("*", value)
