"""Tessera: an OLAP feature set over Spark's DataFrame and SQL API."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: its Python functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
