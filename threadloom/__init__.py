"""threadloom: Spark-first analytics over multi-source post, article and comment corpora."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
