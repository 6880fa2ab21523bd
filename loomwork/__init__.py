"""Text-corpus analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that workers need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
