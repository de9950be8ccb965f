"""Duplicate search, snapshot tables and, in a subpackage of its own, operators of a training-data pipeline on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
