"""Operators of a training-data pipeline. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: the functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules["factloom"])
