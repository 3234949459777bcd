"""Lodestone: ranked text retrieval and corpus preparation, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions handed to executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
