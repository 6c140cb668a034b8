"""Training-data pipeline operators: scoring, deduplication, filtering, archives and mixing."""

import sys

from pyspark import cloudpickle

# Executors get these functions by value, so that they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
