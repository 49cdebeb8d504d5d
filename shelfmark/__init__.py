"""Audit and reconciliation of catalogs of packaged, page-based content, on Spark."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel by value, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
