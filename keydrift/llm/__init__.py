"""Operators for preparing training data; nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
