"""factloom: a Spark-native engine that turns a document corpus into an index of the entities named in it."""

import sys

from pyspark import cloudpickle

from factloom.session import get_spark, shared_dir

# Executors need no copy of the package: the functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules["factloom"])

__all__ = ["get_spark", "shared_dir"]
