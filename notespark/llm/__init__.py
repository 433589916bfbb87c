"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks get these functions with the plan, so executors needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
