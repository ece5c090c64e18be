"""Weighbridge: evidence features, scores and corpus operators as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
