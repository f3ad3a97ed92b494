"""Operators of a training-data pipeline over tables of documents."""

import sys

from pyspark import cloudpickle

import blattwerk

# Functions travel to the workers inside the plan; nothing is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(blattwerk)
