"""weftline: table-level Spark jobs over message, feed and document data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions used inside tasks travel with the job, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
