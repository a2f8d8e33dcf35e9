"""nearshelf: catalog similarity search and recommendation as Spark DataFrame operators.

The few functions that run in Python workers travel with the job by value, so
executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
