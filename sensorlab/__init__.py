"""sensorlab: labelling, feature preparation, random-hidden-layer networks,
linear models and their evaluation for multi-channel sensor tables on Spark.

Every operator takes and returns DataFrames.  Only model-sized data (weights,
triangular factors, one-row statistics) reaches the driver.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel with the task, so a cluster needs no
# copy of this package on its worker nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
