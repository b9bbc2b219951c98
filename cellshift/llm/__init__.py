"""Operators for training data.

Functions of this package travel to the executors with the code they use, so nothing but
the public libraries has to be installed or on a path there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
