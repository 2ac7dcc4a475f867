"""Operators of a training-data pipeline."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors inside the job, so that these need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
