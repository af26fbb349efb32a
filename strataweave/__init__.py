"""strataweave: a PySpark-native engine for versioned, evidence-backed graphs of text."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
