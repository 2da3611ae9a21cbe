"""Operators for building training corpora, and their queries."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need no copy of the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
