"""Operators for preparing a text corpus for training. Nothing else in the package imports this part."""

import sys

from pyspark import cloudpickle

# Functions of this part travel to the executors by value, so they need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
