"""isobar: gridded time-series analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job
# (pickled by value), so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
