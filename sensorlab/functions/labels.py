"""Column expressions that turn an activity code or a score into a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Activity codes 1 (standing), 2 (sitting) and 3 (lying) are inactive.
INACTIVE = (1.0, 3.0)

# Fixed value: readings are taken 50 times a second.
SECONDS_PER_READING = 0.02


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_labelled(activity="activityLabel") -> Column:
    return _col(activity) > 0


def binary_label(activity="activityLabel", dtype: str = "double") -> Column:
    """0 for an inactive code (1 to 3 inclusive), 1 for any other."""
    inactive = _col(activity).between(*INACTIVE)
    return F.when(inactive, F.lit(0).cast(dtype)).otherwise(F.lit(1).cast(dtype))


def above(value, threshold: float, dtype: str = "double") -> Column:
    """1 where the value exceeds the threshold, else 0."""
    return F.when(_col(value) > threshold, F.lit(1).cast(dtype)).otherwise(F.lit(0).cast(dtype))


def velocity(x, y, z, dt: float = SECONDS_PER_READING) -> Column:
    """Speed gained over one sampling interval by a three-axis acceleration."""
    return F.sqrt(sum((_col(a) * F.lit(dt)) * (_col(a) * F.lit(dt)) for a in (x, y, z)))


def squared_difference(prediction="prediction", label="binaryLabel") -> Column:
    gap = _col(prediction) - _col(label)
    return gap * gap
