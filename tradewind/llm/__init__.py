"""Operators for preparing training data: deduplication, scans, mixing, sharding and filtering of documents.

Nothing outside this package imports it. Its functions travel to the executors by value, so a cluster
needs no copy of the package on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
