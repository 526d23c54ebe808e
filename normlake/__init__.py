"""Compliance text analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so a worker needs no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
