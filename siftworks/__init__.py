"""siftworks: a PySpark-native engine for curating streams of text items."""

import sys

from pyspark import cloudpickle

# Functions that go to Python workers are sent whole, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
