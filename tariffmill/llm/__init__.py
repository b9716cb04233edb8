"""Operators for preparing training text: scoring, cleaning, de-duplication, sharding, encoding and packing."""

import sys

from pyspark import cloudpickle

# Tasks carry this package's functions by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
