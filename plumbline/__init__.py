"""Tolerance analytics on Spark: joins, sequences, graphs and fits where equality is the exception."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
