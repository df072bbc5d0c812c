"""Spark-native analytics for numbered-marker images and the tables that come of them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so they need no installed copy there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
