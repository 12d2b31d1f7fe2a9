"""Post extraction and feed processing over captured page snapshots, as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Send this package's functions to Python workers by value: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
