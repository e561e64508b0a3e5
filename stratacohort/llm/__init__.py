"""Operators for preparing training corpora.

Nothing outside this folder imports it.  Functions that run on executors are shipped by value, so executors
need the installed libraries but not this package on their path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
