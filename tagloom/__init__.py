"""Concept-tagged dataset construction and evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
