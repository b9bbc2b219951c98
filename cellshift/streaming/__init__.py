"""Streaming cycles.

The stateful functions of this package travel to the executors with the code they use, so the
package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
