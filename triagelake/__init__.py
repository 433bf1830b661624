"""Spark-native triage of system logs: parse, window, score, gate, retrieve, cite, reason, audit."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel with their code, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
