"""Spark-native analytics over collections of warehouse scripts and the workloads they describe."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
