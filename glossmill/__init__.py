"""A Spark-native engine for text-corpus and vocabulary analytics."""

import sys

from pyspark import cloudpickle

# Python stages carry this package's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
