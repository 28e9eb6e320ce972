"""Operators for building training corpora. Nothing else in the library imports this subpackage.

Functions that run on executors are pickled by value, so that executors need the
libraries but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
