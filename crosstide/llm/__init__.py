"""Operators of a training-data pipeline; nothing else in the package imports this one.

Functions that run on executors are pickled by value, so executors need only
the public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
