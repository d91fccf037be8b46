"""Spark-first library of document, event and vector operators: plain DataFrame-to-DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
