"""Company-intelligence operators as PySpark DataFrame code."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a job runs
# where the package is not installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
