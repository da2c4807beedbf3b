"""Operators for building training corpora: deduplication, mixing, packing, classification, extraction, sharding."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
