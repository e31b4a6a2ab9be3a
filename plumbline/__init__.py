"""Statistical analysis and modelling of tables as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The small Python helpers travel inside the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
