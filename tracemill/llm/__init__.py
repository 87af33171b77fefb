"""Operators of a training-data pipeline: one module each, queries in ``queries``."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with the plan, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
