"""Operators for preparing training data at corpus scale; nothing else in the library imports this subpackage.

Functions of this subpackage travel to executors by value, so that these need the libraries it uses but not the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
