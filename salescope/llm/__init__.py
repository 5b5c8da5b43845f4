"""Operators that prepare training data; nothing else in the library imports them.

Functions of this subpackage travel to the executors by value, so that a job
runs without the package being installed or shipped there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
