"""Spark-native analytics for multi-source public-notice data."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
