"""Area profiling on Spark: every public function takes and returns DataFrames."""

import sys

from pyspark import cloudpickle

# tasks get the package's functions with their code, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
