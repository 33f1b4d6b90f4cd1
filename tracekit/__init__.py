"""Spark jobs that prepare traces, encode and resample tables, and score synthetic copies."""

import sys

from pyspark import cloudpickle

# Executors get the few Python helpers by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
