"""readloom: amplicon and shotgun variant analytics as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to executors by value, so no executor needs a copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
