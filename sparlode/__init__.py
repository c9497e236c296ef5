"""A Spark-native engine for vector, lexical and hybrid retrieval, with training-data operators in ``sparlode.llm``."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
