"""Spark-native sequence-motif and comparative-genomics operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers with their code, so executors
# do not need it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
