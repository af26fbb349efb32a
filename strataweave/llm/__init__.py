"""Training-data pipeline operators. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
