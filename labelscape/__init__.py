"""Spatial topology of labelled point clouds, computed with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few vectorised helpers that run inside tasks travel with the query, so that executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
