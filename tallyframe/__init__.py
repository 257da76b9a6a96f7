"""tallyframe: transaction analytics as plain DataFrame -> DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get the functions themselves: the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
