"""Transaction anomaly analytics on Spark: every operator maps DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so that executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
