"""Spark-native dataset curation: declarative operators over DataFrames."""

import sys

from pyspark.cloudpickle import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the plan, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
