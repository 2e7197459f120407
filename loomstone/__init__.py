"""Loomstone: Spark-native analytics for web pages and text documents.

Functions of this package that Spark ships to Python workers are pickled by
value, so executors need no copy of the package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
