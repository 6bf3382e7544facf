"""A Spark-native document analytics engine.

Functions that run in Python workers travel by value: executors need the libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
