"""Distributional regression on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to workers carry their code, so that executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
