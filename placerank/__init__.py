"""Content-based place recommendation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that tasks run are sent whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
