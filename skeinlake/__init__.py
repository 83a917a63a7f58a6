"""A PySpark-native retrieval and analytics engine.

Python functions of the package travel to the executors by value, so a cluster
needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
